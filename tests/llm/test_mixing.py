from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from pricewren.llm import mixing, queries
from tests.llm.making import ODD, SF_DIR, crowded, documents, empty


def rake(cells: dict, targets: dict, steps: int = 400) -> dict:
    """Plain proportional fitting over a dictionary of cells."""
    fitted = {k: float(v) for k, v in cells.items() if v}
    for _ in range(steps):
        for m in range(3):
            names = {k[m] for k in fitted}
            goal = {x: targets[m].get(x, 0.0) for x in names}
            whole = sum(goal.values())
            sums = {x: sum(v for k, v in fitted.items() if k[m] == x) for x in names}
            fitted = {k: v * goal[k[m]] / whole / sums[k[m]] if sums[k[m]] else 0.0 for k, v in fitted.items()}
    return fitted


def kept_by_hand(docs, share):
    """The ids of the rows that a plain reading of the sampling keeps: cells by counting, probabilities by the driver's fit, draws by their hash."""
    rows = docs.select("*", mixing.form_topic(F.col("text")).alias("form"), mixing.token_weight(F.col("text")).alias("n_words"), mixing.unit_hash(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")), seed=4).alias("u")).collect()
    cells, cell = {}, lambda r: (r["source"] or mixing._NULL, r["lang"] or mixing._NULL, r["form"])
    for r in rows:
        assert r["n_words"] == len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or ""))
        cells[cell(r)] = cells.get(cell(r), 0) + r["n_words"]
    keys = sorted(k for k, v in cells.items() if v)
    targets = []
    for m in range(3):
        t = {x: sum(cells[k] for k in keys if k[m] == x) ** mixing.TEMPER for x in {k[m] for k in keys}}
        targets.append({x: v / sum(t.values()) for x, v in t.items()})
    found = mixing.bounded_in_driver([np.array([k[m] for k in keys]) for m in range(3)], np.array([cells[k] for k in keys]), targets, share)
    chance = dict(zip(keys, found))
    return sorted(r["doc_id"] for r in rows if r["u"] < chance.get(cell(r), 1.0))


def test_query_by_hand(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert sorted(r["doc_id"] for r in queries.op4_mixing(spark, SF_DIR).collect()) == kept_by_hand(docs, mixing.KEEP_SHARE)


def test_fit_both_ways(spark):
    rng = np.random.default_rng(0)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): int(rng.integers(1, 1000)) for a in range(3) for b in range(2) for c in range(3)}
    targets = [{"s0": 0.5, "s1": 0.3, "s2": 0.2}, {"l0": 0.6, "l1": 0.4}, {"t0": 0.2, "t1": 0.5, "t2": 0.3}]
    expected = rake(cells, targets)
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    goals = {m: spark.createDataFrame([*t.items()], "value string, share double") for m, t in zip(mixing.MARGINS, targets)}
    for limit, steps, off in ((mixing.DRIVER_CELLS, 60, 1e-6), (0, 3, 2e-2)):
        found = {(r["source"], r["lang"], r["topic"]): r["share"] for r in mixing.fit(df, goals, steps, limit).collect()}
        assert max(abs(found[k] - expected[k]) for k in expected) < off


def test_query_meets_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = mixing.sample(docs)
    cells = docs.select(F.coalesce("source", F.lit(mixing._NULL)).alias("source"), F.coalesce("lang", F.lit(mixing._NULL)).alias("lang"), mixing.form_topic(F.col("text")).alias("topic"), mixing.token_weight(F.col("text")).alias("t"))
    sums = {(r[0], r[1], r[2]): r[3] for r in cells.groupBy("source", "lang", "topic").agg(F.sum("t")).collect()}
    targets = []
    for m in range(3):
        t = {x: sum(v for k, v in sums.items() if k[m] == x) ** mixing.TEMPER for x in {k[m] for k, v in sums.items() if v}}
        targets.append({x: v / sum(t.values()) for x, v in t.items()})
    fitted = rake(sums, targets, 100)
    top = max(v / sums[k] for k, v in fitted.items())
    rows = kept.select("source", "lang", mixing.form_topic(F.col("text")).alias("topic"), "mix_probability").distinct().collect()
    for r in rows:
        k = (r["source"] or mixing._NULL, r["lang"] or mixing._NULL, r["topic"])
        if sums[k]:
            assert abs(r["mix_probability"] - fitted[k] / sums[k] / top) < 1e-4
    assert 0 < kept.count() < docs.count()
    assert {tuple(r) for r in kept.select("doc_id", "text").collect()} == {tuple(r) for r in mixing.sample(docs.repartition(7)).select("doc_id", "text").collect()}


def test_bounded_both_ways(spark):
    """One cell is wanted in twice its tokens: it is kept in whole, a half of all tokens is kept, and the margins are met by the other cells."""
    cells = {("s0", "l0", "t0"): 10, ("s0", "l1", "t0"): 90, ("s1", "l0", "t0"): 400, ("s1", "l1", "t0"): 500}
    targets = [{"s0": 0.15, "s1": 0.85}, {"l0": 0.6, "l1": 0.4}, {"t0": 1.0}]
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    goals = {m: spark.createDataFrame([*t.items()], "value string, share double") for m, t in zip(mixing.MARGINS, targets)}
    near, far = ({(r["source"], r["lang"]): r["probability"] for r in mixing.bounded(df, goals, 0.5, limit).collect()} for limit in (mixing.DRIVER_CELLS, 0))
    assert max(abs(near[k] - far[k]) for k in near) < 1e-6 and near["s0", "l0"] == 1.0 and max(near.values()) <= 1.0
    kept = {k: near[k[:2]] * v for k, v in cells.items()}
    assert abs(sum(kept.values()) - 500) < 1e-3
    assert abs(kept["s0", "l0", "t0"] + kept["s0", "l1", "t0"] - 75) < 0.1 and abs(kept["s0", "l0", "t0"] + kept["s1", "l0", "t0"] - 300) < 0.1


def test_a_stray_document_changes_little(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    stray = spark.createDataFrame([(10**9, "word " * 50, "xx", "a source of its own", 250)], docs.schema)
    docs.unionByName(stray).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = ({r["doc_id"]: r["n_tokens"] for r in queries.op4_mixing(spark, f"{tmp_path}/{x}").collect()} for x in "ab")
    tokens = docs.agg(F.sum(mixing.token_weight(F.col("text")))).first()[0]
    assert 10**9 in b and len(a.keys() ^ b.keys()) < 0.02 * docs.count()
    assert abs(sum(a.values()) / tokens - mixing.KEEP_SHARE) < 0.05 and abs(sum(b.values()) / tokens - mixing.KEEP_SHARE) < 0.05


def test_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("lang", F.when(F.col("doc_id") > 4, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") < 4, F.col("source")))
    kept = mixing.sample(crowded(docs))
    assert set(kept.columns) == {*crowded(docs).columns, "mix_probability"} and 0 < kept.count() <= len(ODD)
    assert kept.where("mix_probability <= 0 or topic <> 'x'").count() == 0
    assert mixing.sample(empty(spark)).count() == 0
    assert mixing.sample(documents(spark, [(1, None), (2, "")])).count() == 2
    assert queries.op4_mixing(spark, SF_DIR).where("mix_probability > 1 or mix_probability <= 0").count() == 0
