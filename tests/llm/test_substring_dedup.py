from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from pricewren.llm import queries, substring_dedup
from tests.llm.making import ODD, SF_DIR, crowded, documents, empty, prose


def plainly(rows, words=13):
    """doc_id, n_words, removed intervals and kept words of each row, by a dictionary of all windows."""
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict[tuple, float] = {}
    order = lambda i: float("inf") if i is None else i
    for i, ws in cut:
        for k in range(len(ws) - words + 1):
            w = tuple(ws[k : k + words])
            first[w] = min(first.get(w, float("inf")), order(i))
    for i, ws in cut:
        gone = set()
        for k in range(len(ws) - words + 1):
            if first[tuple(ws[k : k + words])] < order(i):
                gone.update(range(k, k + words))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        yield i, len(ws), spans, " ".join(w for k, w in enumerate(ws) if k not in gone)


def found(df):
    return [(r["doc_id"], r["n_words"], [[s["start"], s["end"]] for s in r["removed"]], r["kept"]) for r in df.collect()]


def in_order(rows):
    return sorted(rows, key=repr)


def test_query_against_all_windows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = queries.op13_substring_dedup(spark, SF_DIR).collect()
    right = [(i, n, sum(b - a for a, b in spans), hashlib.sha256(kept.encode()).hexdigest()) for i, n, spans, kept in plainly(docs)]
    assert in_order(tuple(r) for r in rows) == in_order(right)
    assert any(n for _, _, n, _ in right) and not all(n for _, _, n, _ in right)


def test_passages_groups_of_copies_and_odd_rows(spark):
    rng = random.Random(3)
    shared = prose(12, 30, seed=8)
    docs = [(i, " ".join(rng.choice([*shared, *own.split(". ")]) for _ in range(3))) for i, own in enumerate(prose(120, 9, seed=2))]
    docs += [(500 + i, shared[0]) for i in range(80)] + [(None, shared[0]), (None, shared[0]), (None, "words of its own " * 9), (None, "words of its own " * 9)] + ODD
    docs += [(7, shared[1]), (600, "a b " * 40), (601, "b a " * 40), (-5, shared[2]), (602, "\t".join(shared[3].split())), (603, shared[4].upper())]
    rng.shuffle(docs)
    assert in_order(found(substring_dedup.substring_dedup(crowded(documents(spark, docs))))) == in_order(plainly(docs))
    assert in_order(found(substring_dedup.substring_dedup(documents(spark, docs), words=1))) == in_order(plainly(docs, 1))
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    shared = prose(20, 20, seed=9)
    docs = [(i, " ".join(rng.choice(shared) for _ in range(4))) for i in range(300)]
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", (9000, 9000))
    assert substring_dedup.split(sum(len(t) for _, t in docs)) > 10
    assert in_order(found(substring_dedup.substring_dedup(documents(spark, docs).repartition(5)))) == in_order(plainly(docs))


def test_rows_between_blocks_and_parts_grow_with_the_input():
    pairs = [substring_dedup.split(n) ** 2 for n in (1 << 32, 1 << 34, 1 << 36)]
    assert pairs[1] <= 4.1 * pairs[0] and pairs[2] <= 4.1 * pairs[1] and substring_dedup.split(0) == 1


def test_long_texts_are_hashed_in_runs(monkeypatch):
    texts = [t.encode() for t in [*prose(6, 400), "", "x", "no-gap" * 900, " ".join(prose(30, 80))]]
    whole, n = substring_dedup.word_hashes(texts)
    monkeypatch.setattr(substring_dedup, "RUN_BYTES", 200)
    parts, m = substring_dedup.word_hashes(texts)
    assert np.array_equal(whole, parts) and np.array_equal(n, m) and n.tolist() == [len(t.split()) for t in texts]


def test_planes_give_numbers_back():
    codes = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert np.array_equal(substring_dedup._numbers(substring_dedup._planes(codes)), codes)
