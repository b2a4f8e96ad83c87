from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import functions as F

from pricewren.llm import language_id, queries
from tests.llm.making import ODD, crowded, documents, empty


def code_length(model_texts, text):
    """Bits of a text under order-3 prediction by partial matching with frozen counts (method C), byte by byte."""
    counts = [{} for _ in range(4)]
    for t in model_texts:
        data = b"\0\0\0" + t.encode()
        for i in range(3, len(data)):
            for k in range(4):
                counts[k].setdefault(data[i - k : i], {}).setdefault(data[i], 0)
                counts[k][data[i - k : i]][data[i]] += 1
    bits, data = 0.0, b"\0\0\0" + text.encode()
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            seen = counts[k].get(data[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += math.log2(total / seen[data[i]])
                break
            bits += math.log2(total / len(seen))
        else:
            bits += 8
    return bits


def test_code_lengths_against_plain_counting(spark):
    texts = {"en": ["the cat sat on the mat", "that hat"], "de": ["die katze sass auf der matte", "der hut"]}
    rows = [(n, t, lang) for lang, ts in texts.items() for n, t in enumerate(ts)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for t in ("the hat", "der matte zebra", "xyz", "Ünï"):
        found = model.code_lengths([t.encode()])[0]
        for j, lang in enumerate(model.languages):
            assert abs(found[j] - code_length(texts[lang], t)) < 1e-3 * (1 + len(t))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").where("lang is not null")
    rows = queries.op9_language_id(spark, sf_dir).join(langs, "doc_id").where("held_out and lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    found = language_id.predict(crowded(docs), language_id.train(docs)).collect()
    assert sorted(r["lang_pred"] for r in found) == sorted("en" if t and any(map(str.isalpha, t)) else "und" for _, t in ODD)
    assert all(0 <= r["score"] <= 1 for r in found)
    untrained = language_id.train(empty(spark))
    assert {r["lang_pred"] for r in language_id.predict(docs, untrained).collect()} == {"und"}
    assert language_id.predict(empty(spark), untrained).count() == 0


def test_model_grows_with_what_is_seen():
    """Forty languages over all byte values stay small, and a text beyond the size of a run gets the bits of its parts."""
    rng = np.random.default_rng(3)
    counts = {f"l{i:02d}": np.unique(rng.integers(0, 1 << 32, 20_000, dtype=np.uint64), return_counts=True) for i in range(40)}
    model = language_id.LanguageModel(counts)
    size = sum(t.keys.nbytes + t.values.nbytes + t.used.nbytes for tree in model.trees for t in (*tree.seen, *tree.escape)) + sum(tree.low.nbytes for tree in model.trees)
    assert size < 200_000_000 and len(pickle.dumps(model)) < 10_000_000
    text = bytes(rng.integers(0, 256, 3000, dtype=np.uint8))
    whole = model.code_lengths([text])[0]
    run, language_id.RUN_BYTES = language_id.RUN_BYTES, 700
    try:
        assert np.allclose(model.code_lengths([text])[0], whole, rtol=1e-5)
        assert np.allclose(model.code_lengths([b"ab", b"", text, b"cd"])[2], whole, rtol=1e-5)
    finally:
        language_id.RUN_BYTES = run


def test_tables():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 32, 5_000, dtype=np.uint64)).astype(np.uint32)
    table = language_id.Table(keys[::2], np.arange(len(keys[::2]), dtype=np.float64))
    values, there = table.find(keys)
    assert there[::2].all() and not there[1::2].any() and (values[::2] == np.arange(len(keys[::2]))).all() and not values[1::2].any()
    assert not language_id.Table(keys[:0], np.zeros(0)).find(keys)[1].any()


def test_no_language_is_left_out(spark):
    """300 languages, each of an alphabet of its own, some of one long text and with a sample far smaller than the texts."""
    rows = []
    for i in range(300):
        a, b = chr(0x4E00 + 2 * i), chr(0x4E01 + 2 * i)
        rows += [(3 * i + j, (a + b + " ") * (40 if i % 7 else 400) + a * j) for j in range(3)]
    docs = documents(spark, rows).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") / 3).cast("int").cast("string")))
    model = language_id.train(docs, sample_bytes=200, all_bytes=30_000)
    assert len(model.languages) == 300
    found = language_id.predict(docs, model).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] // 3}" for r in found)
