from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer, decoders

from pricewren.llm import alignment, queries
from tests.llm.making import ODD, SF_DIR, crowded, documents, empty, prose

A_PATH, B_PATH = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plainly(rows):
    """The result for (doc_id, text), each text encoded whole, links as sets of ends."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letters = alignment._shown_bytes()
    count: Counter = Counter()
    read = []
    for i, text in rows:
        xs, ys = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bx = [bytes(letters[c] for c in a.id_to_token(x)) for x in xs]
        by = [bytes([int(p[3:5], 16)]) if b.is_byte(y) else p.replace("▁", " ").encode() for y in ys for p in [b.id_to_piece(y)]]
        if text and not b"".join(bx) == b"".join(by) == (" " + text).encode():
            xs, ys, bx, by = [], [], [], []
        ends_x, ends_y = (dict(zip(accumulate(map(len, bytes_)), ids, strict=True)) for ids, bytes_ in ((xs, bx), (ys, by)))
        common = sorted(ends_x.keys() & ends_y.keys())
        links = [(ends_x[e], ends_y[e]) for e in common]
        sides: list[list[list[str]]] = []
        for ends in (ends_x, ends_y):  # each token falls to the first common end at or behind its own
            sides.append([[] for _ in common])
            for at, t in ends.items():
                sides[-1][bisect_left(common, at)].append(str(t))
        groups = [",".join(g) + "|" + ",".join(h) for g, h in zip(*sides, strict=True)]
        count.update(links)
        read.append((i, len(xs), len(ys), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if xs else ""))
    top: dict[int, int] = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(i, n_a, n_b, len(links), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), sha) for i, n_a, n_b, links, sha in read]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_decoding_of_bytes():
    letters = alignment._shown_bytes()
    decode = decoders.ByteLevel().decode
    assert sorted(letters.values()) == list(range(256)) and all(decode([c]).encode() == bytes([n]) for c, n in letters.items() if n < 128)


def test_query_against_whole_texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert in_order(queries.op11_alignment(spark, SF_DIR).select(COLUMNS).collect()) == in_order(plainly(docs))


def odd_texts():
    rng = random.Random(4)
    some = ["a  b", "  lead", "trail  ", "x\n y", "x \ny\n\n  z ", "it's  'll", "▁ made", "a▁b", "<|endoftext|> <s></s> <unk>", "日本語 テキスト", "🙂🙂 🙂", "   x", "tab\t \tx", "\x00 \x01", "ﬁne ①", "é é", " ", "     ", "a" * 900]
    some += ["".join(rng.choice(" \n\tab'sé日1.▁") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    some += ["".join(rng.choice(" \n\tab'sé日1.<>|") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [(100 + i, t) for i, t in enumerate(some)]


def test_odd_rows(spark):
    docs = [*ODD, *odd_texts(), *((900 + i, t) for i, t in enumerate(prose(20))), *((2000 + i, "same text here") for i in range(60))]
    assert in_order(alignment.align(crowded(documents(spark, docs)), A_PATH, B_PATH).select(COLUMNS).collect()) == in_order(plainly(docs))
    assert alignment.align(empty(spark), A_PATH, B_PATH).count() == 0


def test_many_groups_of_a_part(spark, monkeypatch):
    docs = [*odd_texts(), *((900 + i, t) for i, t in enumerate(prose(60)))]
    monkeypatch.setattr(alignment, "GROUP_BYTES", 64)
    out = alignment.align(documents(spark, docs).repartition(7), A_PATH, B_PATH)
    assert in_order(out.select(COLUMNS).collect()) == in_order(plainly(docs))


def test_forgetting_and_whole_texts():
    texts = [t for _, t in odd_texts()]
    aligner = alignment.Aligner(A_PATH, B_PATH)
    assert aligner.cuts
    right = aligner.run(texts)
    aligner.cuts = False
    aligner.forget()
    whole = aligner.run(texts)
    assert right[0].tolist() == whole[0].tolist() and right[1] == whole[1] and right[2].tolist() == whole[2].tolist()
