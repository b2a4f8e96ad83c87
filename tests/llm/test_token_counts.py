from __future__ import annotations

import random
import time

import public_tokenizers
import sentencepiece

from pricewren.llm import queries, token_counts
from tests.llm.making import ODD, SF_DIR, crowded, documents, empty, prose

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


def test_query_against_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op6_token_counts(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        n = len(model.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_splicing_at_small_chunks():
    counter = token_counts.PieceCounter(PATH, chunk=64, overlap=16)
    rng = random.Random(5)
    texts = [*prose(10, 100), "a" * 1000, " " * 500, "ab" * 700, "日本語テキスト" * 60, "🙂" * 150, "x\n\n  y" * 90, "".join(chr(rng.randrange(32, 0x250)) for _ in range(2000)), "▁▁ ▁" * 100, "<s></s><unk>" * 40]
    for t in texts:
        assert counter.count(t) == len(counter.model.encode(t)), t[:40]


def test_texts_without_boundaries_take_linear_time():
    counter = token_counts.PieceCounter(PATH)
    for text in ("a" * 4_000_000, "b" * 100_000 + " " + "a" * 300_000 + "日" + "b" * 70_000, "word " + "a" * 80_000 + " end " * 20_000):
        began = time.process_time()
        n = counter.count(text)
        took = time.process_time() - began
        began = time.process_time()
        assert n == len(counter.model.encode(text, return_type="numpy"))
        assert took < 6 * (time.process_time() - began) + 1


def test_odd_rows(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = token_counts.token_counts(crowded(documents(spark, ODD)), PATH, limit=10).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == sorted((i or 0, len(model.encode(t or ""))) for i, t in ODD)
    assert token_counts.token_counts(empty(spark), PATH, limit=10).count() == 0
