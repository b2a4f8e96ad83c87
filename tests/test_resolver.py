"""Open pairs through cache, quota and resolver: clamps, one question for each fingerprint, answers written once."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewren.operators import resolver
from pricewren.sources import keyed

PAIRS = "owner long, query_id long, query string, candidate_id long, candidate string, relation string, confidence double, needs_review boolean, method string"


def test_second_run_asks_nothing(spark, tmp_path):
    rows = [
        (1, 1, "lamp", 1, "same_product", "possible", 0.6, True, "words"), (1, 1, "lamp", 2, "same_family", "possible", 0.7, True, "words"), (1, 1, "lamp", 3, "unrelated", "possible", 0.4, True, "words"),
        (1, 1, "lamp", 4, "same_product", "conflict", 0.1, True, "spec"), (1, 1, "lamp", 5, "compatible", "possible", 0.2, False, "words"), (1, 2, "lamp", 6, "same_product", "possible", 0.5, True, "words"),
        (1, 3, None, 7, None, "possible", 0.5, True, "words"), (2, 4, "lamp", 8, "compatible", "possible", 0.5, True, "words"),
    ]
    pairs, asked = spark.createDataFrame(rows, PAIRS), []

    def answers(table):
        asked.extend(sorted(str(r["candidate"]) for r in table.collect()))
        return table.where("candidate <> ''").select("fingerprint", F.col("candidate").alias("relation"), F.lit(0.99).alias("confidence"), F.lit("").alias("reason"))

    quota, folder = spark.createDataFrame([(1, 5)], "owner long, remaining long"), str(tmp_path)
    read = lambda: keyed.read(spark, folder, resolver.ANSWER)
    told = lambda out: {r["candidate_id"]: (r["relation"], r["confidence"], r["method"], r["answered"]) for r in out.collect()}
    out, new = resolver.resolve(pairs, read(), quota, answers, "m")
    same = {4: ("conflict", 0.1, "spec", None), 5: ("possible", 0.2, "words", None), 8: ("possible", 0.5, "words", "quota")}
    assert told(out) == same | {
        1: ("same_product", 0.94, "ai", "resolver"), 2: ("same_family", 0.6, "ai", "resolver"), 3: ("unrelated", 0.4, "ai", "resolver"), 6: ("same_product", 0.94, "ai", "resolver"), 7: ("possible", 0.5, "words", "silent"),
    }
    assert asked == ["None", "same_family", "same_product", "unrelated"]
    assert resolver.remember(folder, new, 1) and not resolver.remember(folder, new, 1) and read().count() == 3
    asked.clear()
    out, new = resolver.resolve(pairs, read(), quota, answers, "m")
    assert told(out) == same | {1: ("same_product", 0.94, "ai", "cache"), 2: ("possible", 0.5, "ai", "cache"), 3: ("possible", 0.4, "ai", "cache"), 6: ("same_product", 0.94, "ai", "cache"), 7: ("possible", 0.5, "words", "silent")}
    assert asked == ["None"] and new.count() == 0
    assert {x[3] for x in told(resolver.resolve(pairs, read(), quota.where("false"), answers, "other")[0]).values()} == {None, "quota"}


def test_the_strongest_are_asked(spark):
    pairs = spark.createDataFrame([(1, q, "x", c, f"c{c % 20}", "possible", (c % 10) / 10, True, "w") for q in (1, 2) for c in range(30)], PAIRS)
    got = resolver.questions(pairs, "m", 4).orderBy("query_id", "place").select("query_id", "candidate_id").collect()
    assert [tuple(r) for r in got] == [(q, c) for q in (1, 2) for c in (9, 19, 29, 8)]
    misses = resolver.questions(pairs, "m", 4)
    admitted = resolver.admitted(misses, spark.createDataFrame([(1, 6)], "owner long, remaining long")).where("admitted").select("query_id", "place").collect()
    assert sorted(tuple(r) for r in admitted) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]
