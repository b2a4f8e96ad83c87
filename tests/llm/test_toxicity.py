from __future__ import annotations

from pyspark.sql import functions as F

from pricewren.llm import queries, toxicity
from tests.llm.making import ODD, crowded, documents, empty


def rank_share(scored) -> float:
    """Share of pairs of a toxic and a calm row that the score orders rightly."""
    toxic, calm = [s for s, y in scored if y], [s for s, y in scored if not y]
    return sum((a > b) + 0.5 * (a == b) for a in toxic for b in calm) / (len(toxic) * len(calm))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"  # smaller tables label too few toxic rows to learn from
    found = queries.op2_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    assert len(rows) > 400
    assert rank_share([(r["score"], r["toxic"]) for r in rows]) > 0.95
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.9
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_lexicon():
    lex = toxicity.Lexicon({" badword ": 3.0, " bad": 1.0}, ("badword park",))
    assert lex.weigh("A BADWORD!") == (3.0, 2)
    assert lex.weigh("b4dw0rd, bаdword") == (6.0, 2)  # digits, and a Cyrillic letter
    assert lex.weigh("the badword park") == (0.0, 3)
    assert lex.weigh("badly") == (1.0, 1)
    assert lex.weigh(None) == (0.0, 0) and lex.weigh("") == (0.0, 0)
    assert lex.score(*lex.weigh("badword")) > lex.score(*lex.weigh("badword " + "calm " * 50)) > lex.score(0.0, 3) - 1e-12


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (None, 1, 1), (99, 1, None)], "doc_id long, quality int, toxic int")
    lex = toxicity.train(docs, labels, F.lit(True))
    found = toxicity.score(crowded(docs), lex).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(empty(spark), lex).count() == 0
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {toxicity.Lexicon({}, offset=-40.0).score(0.0, 1)}
    assert toxicity.clean(docs, none).count() == len(ODD)
