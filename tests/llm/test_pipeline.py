from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from pricewren.llm import mixing, secrets, toxicity
from pricewren.llm.common import held_out
from tests.llm.making import ODD, SF_DIR, crowded, documents, empty, prose
from tests.llm.test_jaccard_join import brute
from tests.llm.test_mixing import kept_by_hand
from tests.llm.test_packing import check
from tests.llm.test_secrets import base


def test_stages_by_hand(spark):
    """Each stage on what its predecessor kept, against plain Python."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    calm = corpus_pipeline.drop_toxic(spark, docs, SF_DIR).persist()
    lexicon = toxicity.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"), ~held_out(F.col("doc_id")))
    assert sorted(r["doc_id"] for r in calm.collect()) == sorted(r["doc_id"] for r in docs.collect() if lexicon.score(*lexicon.weigh(r["text"])) < 0.5)
    assert 0.8 * docs.count() < calm.count() <= docs.count()

    rows = [(r["doc_id"], r["text"]) for r in calm.collect()]
    kept = corpus_pipeline.drop_near_duplicates(spark, calm, SF_DIR).persist()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in brute(rows, 5, 4, 5) if d == c)

    masked = corpus_pipeline.mask_secrets(spark, kept, SF_DIR).persist()
    assert masked.columns == corpus_pipeline.COLUMNS and masked.count() == kept.count()
    model = secrets.train(secrets.random_strings(spark).unionByName(secrets.ordinary_strings(kept)))
    found = {r["doc_id"]: r["found"] for r in secrets.scan(kept, model).collect()}
    by_id = {r["doc_id"]: r for r in masked.collect()}
    for r in kept.collect():
        text, at, out = r["text"], 0, ""
        for s in sorted(found[r["doc_id"]]):
            if s["start"] >= at:
                out += text[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        want = out + text[at:] if out else text
        assert (by_id[r["doc_id"]]["text"], by_id[r["doc_id"]]["n_chars"]) == (want, len(want) if out else r["n_chars"])
        assert not base(want)

    mixed = corpus_pipeline.mix(spark, masked, SF_DIR)
    assert sorted(r["doc_id"] for r in mixed.collect()) == kept_by_hand(masked, mixing.KEEP_SHARE)
    check(corpus_pipeline.pack(spark, masked, SF_DIR).collect(), [(r["doc_id"], r["text"]) for r in masked.collect()], 2048)


def one_of_each(rows):
    """Rows (doc_id, text) that stay, by comparing all pairs of rows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    groups = brute([(place, rows[i][1]) for place, i in enumerate(order)], 5, 4, 5)
    return Counter(rows[order[place]] for place, _, c in groups if place == c)


def test_near_duplicates_by_row(spark):
    """Ids that repeat with other texts, repeated rows, and copies without an id."""
    t, u, v = prose(3, 40)
    rows = [(5, t), (7, t), (7, u), (8, t), (9, v), (9, v), (None, t), (None, prose(4, 40)[3]), (None, prose(4, 40)[3]), (1, None), (1, None), (2, " ")]
    found = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, crowded(documents(spark, rows)), SF_DIR).collect())
    assert found == one_of_each(rows)
    assert found == Counter([(5, t), (7, u), (9, v), (None, prose(4, 40)[3]), (1, None), (1, None), (2, " ")])
    rng, many = random.Random(2), []
    for n in range(60):
        words = rng.choice((t, u, v)).split()
        words[rng.randrange(len(words))] = f"x{rng.randint(0, 2)}"
        many.append((rng.choice([None, 1, 2, 3, n]), " ".join(words)))
    found = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, many), SF_DIR).collect())
    assert sum(found.values()) == sum(one_of_each(many).values())


def test_odd_and_empty_tables_pass_each_stage(spark):
    docs = crowded(documents(spark, ODD))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF_DIR)
        if name == "packing":
            assert {r["doc_id"] for r in found.collect()} == {i for i, _ in ODD}
        else:
            assert found.columns == corpus_pipeline.COLUMNS
            texts = {i: t for i, t in ODD}
            assert all(re.sub(r"\[SECRET\]", "", r["text"] or "") in (texts[r["doc_id"]] or "") for r in found.collect())
            assert found.count() == {"near_duplicates": len(ODD) - 2}.get(name, found.count() if name == "mixing" else len(ODD))
        assert stage(spark, empty(spark), SF_DIR).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None
