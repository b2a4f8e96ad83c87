from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pricewren.llm import packing, queries
from tests.llm.making import ODD, SF_DIR, crowded, documents, empty, prose

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, docs, window, exact=True):
    """Each id lies in one piece with its checksum; sequences have no gaps and no padding but a last stretch of powers of two."""
    tokenizer = Tokenizer.from_file(PATH)
    ids = {}
    for i, t in docs:
        ids.setdefault(i, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert by.keys() == ids.keys()
    for i, pieces in by.items():
        assert sum(p["length"] for p in pieces) == sum(map(len, ids[i]))
        for p in pieces:
            crcs = {zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) for x in ids[i] if len(x) == p["doc_tokens"]}
            assert p["ids_crc32"] in crcs
        if len(ids[i]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and (at == window or at & (at - 1) == 0)
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_query_against_the_library(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(queries.op10_packing(spark, SF_DIR).collect(), docs, 2048)


def test_small_window_and_odd_rows(spark):
    docs = ODD + [(100 + i, t) for i, t in enumerate(prose(80, 23))]
    check(packing.pack(crowded(documents(spark, docs)), PATH, window=64).collect(), docs, 64)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_plan_uses_each_length_once():
    rng = np.random.default_rng(2)
    for window in (16, 64, 256):
        histogram = rng.integers(0, 30, window)
        plan, used = packing.Plan(histogram, window), {}
        for length in range(1, window):
            for rank in range(histogram[length]):
                for _, n, q, o in plan.place(length, rank):
                    used.setdefault(q, []).append((o, n))
        for q in used.values():
            q.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(q, q[1:])) and q[0][0] == 0
        full = [sum(n for _, n in q) for q in used.values()]
        assert sum(full) == (histogram * np.arange(window)).sum() and all(f == window or f & (f - 1) == 0 for f in full)


def test_repeats_stay_inside_the_histogram():
    histogram = np.zeros(65, dtype=np.int64)
    histogram[[10, 20, 22, 32, 44, 54]] = [5, 9, 2, 7, 3, 4]
    combos = packing.combinations(histogram, 64)
    counts = packing.repeats(histogram, combos)
    used = np.zeros(65, dtype=np.int64)
    for c, n in zip(combos, counts):
        assert sum(c) == 64
        for m in c:
            used[m] += n
    assert (used <= histogram).all() and counts.sum() > 0


def test_learning_pieces_costs_little_beside_the_library():
    """New pieces have the library's ids, and to learn them costs no more than about as much again as to encode their words."""
    import random
    import time

    import pyarrow as pa

    from pricewren.llm.tokens import TextEncoder

    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñ"
    odd = "ÄÖÜ Éa, ÿ. ª µm, ºC x² ß! ŒUVRE, a,b c'est don't l'été, d'A <b> K̈, ,. ... é́, İx,".split(" ")
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 12))) for _ in range(60_000)]
    text = " ".join([*odd, *(w.capitalize() + rng.choice(["", "", ",", ".", "!)"]) for w in words)])
    assert np.frombuffer(TextEncoder(PATH).encode(pa.array([text]))[0], dtype="<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    ratios = []
    for _ in range(3):
        all_, library = TextEncoder(PATH), TextEncoder(PATH)
        began = time.process_time()
        all_.encode(pa.array([text]))
        learned = time.process_time()
        library.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ratios.append((learned - began) / (time.process_time() - learned))
    assert min(ratios) < 2.5, ratios
