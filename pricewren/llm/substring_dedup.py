"""Removal of passages that a document of a smaller id already has, by Rabin-Karp hashes of every window of words.

Documents are dealt to blocks by ranges of doc_id, so the order of blocks is the order of ids. A block hashes every window of `words` consecutive words
of its documents with a rolling polynomial and sends each distinct hash once, packed by a second polynomial into parts. A part counts, over all blocks, which
hashes an earlier block also sent, and answers each block with one bit for each hash. The block then knows for every window whether its words start in a
document of a smaller id, in an earlier block or in its own; removed windows that touch or overlap merge into maximal intervals of words. So a window is
shuffled as 8 bytes at most once for each block, however many documents share it; no key holds more than its blocks. Bytes of text are summed first, and
say how many blocks and parts there are. A task holds a block: 64 MB of text at most, but for a longer document, and some sixteen
times that in numbers.

Windows count as equal if both polynomials' values are: 64 bits and those that choose the part. Texts are shuffled once, by block; their exchange
serves both uses.

Defined results: null and empty texts have no words; documents of fewer words than a window lose nothing; words are runs of characters other than space and
U+0009 to U+000D, unchanged; rows of one doc_id don't remove each other's words, so repeated rows keep theirs alike; rows without doc_id come behind all
ids and don't remove each other's words; no documents give no rows. Only doc_id and text are read, so other columns, of whatever name, don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.llm.shingles import _BASE, _BLANK, _INVERSE, _power, mix

#: Texts are worked on in stretches of about so many bytes.
RUN_BYTES = 1 << 20
#: Least and greatest bytes of text of a block, and the bytes for each pair of a block and a part in between: so the number of pairs, each of which is
#: a row, grows with the input and not with its square.
BLOCK_BYTES, PAIR_BYTES = (6 << 20, 64 << 20), 1 << 14
#: The base of the polynomial that chooses the part; that of the shingles' serves for words and windows.
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER_INVERSE = np.uint64(pow(int(_OTHER), -1, 1 << 64))
_GAP = re.compile(rb"[ \t-\r]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in stretches of about RUN_BYTES that end between words."""
    at = 0
    while len(data) - at > 2 * RUN_BYTES and (gap := _GAP.search(data, at + RUN_BYTES)):
        yield data[at : gap.start()]
        at = gap.start()
    yield data[at:]


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one behind the other, and each text's number of words."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = _BLANK[data]
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([blank[1:], [True]])) + 1
    letters = (data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data))
    letters[blank] = 0
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(letters, dtype=np.uint64)])
    word = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    first = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))])
    return word, np.diff(first)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one behind the other, and each text's number of words, worked out in runs of bounded size."""
    hashes, counts, run, size = [], np.zeros(len(texts), dtype=np.int64), [], 0
    pieces = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
    for k, (i, piece) in enumerate(pieces):
        run.append((i, piece))
        size += len(piece)
        if size >= RUN_BYTES or k == len(pieces) - 1:
            word, n = _hashed([p for _, p in run])
            hashes.append(word)
            np.add.at(counts, [j for j, _ in run], n)
            run, size = [], 0
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), counts


def _rolling(word: np.ndarray, words: int, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """The polynomial of every `words` words in a row: of a sum over all before, less that before the window."""
    n = len(word) - words + 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word * _power(base, len(word)), dtype=np.uint64)])
    return mix((sums[words:] - sums[:n]) * _power(inverse, len(word))[:n])


class Block:
    """The windows of a block's documents, in order of doc_id."""

    def __init__(self, table: pa.Table, words: int, parts: int):
        table = table.sort_by([("doc_id", "ascending")])  # without an id: last
        self.ids, self.texts = table.column("doc_id").to_pylist(), [(t or "").encode() for t in table.column("text").to_pylist()]
        self.words = words
        del table
        word, self.counts = word_hashes(self.texts)
        ends = np.cumsum(self.counts)
        self.firsts = ends - self.counts
        if len(word) < words:
            self.at = self.group = np.zeros(0, dtype=np.int64)
            self.codes, self.bounds, self.rank_of_first = np.zeros(0, dtype=np.uint64), np.zeros(parts + 1, dtype=np.int64), np.zeros(0, dtype=np.int64)
            return
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.at = np.flatnonzero(np.arange(len(word) - words + 1) + words <= ends[owner[: len(word) - words + 1]])  # windows within one text
        code = _rolling(word, words, _BASE, _INVERSE)[self.at]
        part = (_rolling(word, words, _OTHER, _OTHER_INVERSE)[self.at] % np.uint64(parts)).astype(np.int32)
        del word, owner
        order = np.lexsort((code, part))  # stable: the first of equal windows is that of the smallest id
        new = np.ones(len(order), dtype=bool)
        new[1:] = (code[order[1:]] != code[order[:-1]]) | (part[order[1:]] != part[order[:-1]])
        self.group = np.empty(len(order), dtype=np.int64)  # of each window: its hash's place
        self.group[order] = np.cumsum(new) - 1
        lead = order[new]
        self.codes, self.bounds = code[lead], np.searchsorted(part[lead], np.arange(parts + 1))
        self.rank_of_first = self._rank()[lead]

    def _rank(self) -> np.ndarray:
        """Of each window: its document's id by order; equal ids, and missing ones, are one."""
        ids = np.array([x if x is not None else 0 for x in self.ids], dtype=np.int64)
        null = np.array([x is None for x in self.ids])
        rank = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]) | (null[1:] != null[:-1]))])
        return np.repeat(rank, self.counts)[self.at]

    def sent(self) -> Iterator[tuple[int, np.ndarray]]:
        for p in np.flatnonzero(np.diff(self.bounds)).tolist():
            yield p, self.codes[self.bounds[p] : self.bounds[p + 1]]

    def covered(self, earlier: np.ndarray) -> np.ndarray:
        """Of each word of the block: whether a window covers it whose words start in a document of a smaller id."""
        gone = np.zeros(int(self.counts.sum()) + 1, dtype=np.int64)
        if len(self.at):
            hit = self.at[earlier[self.group] | (self._rank() > self.rank_of_first[self.group])]
            gone[: len(gone)] += np.bincount(hit, minlength=len(gone))
            gone -= np.bincount(hit + self.words, minlength=len(gone))
        return np.cumsum(gone[:-1]) > 0


def _planes(codes: np.ndarray) -> bytes:
    """Sorted numbers byte plane by byte plane, the highest first: those compress."""
    return np.ascontiguousarray(codes.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def range_blocks(docs: DataFrame, key: str, blocks: int, spare: Column) -> Column:
    """An int column that puts docs in about `blocks` ranges of a long key, ascending; rows without a key go to blocks from `blocks` on, as many again, by
    the number `spare`. Only the ranges' bounds reach the driver, one for each block; a row finds its range by bisection in two steps."""
    at = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(docs.agg(F.percentile_approx(key, at, 20 * blocks).alias("b")).first()["b"] or [])) if at else []
    placed = F.lit(0)
    if bounds:
        wide = max(1, int(len(bounds) ** 0.5))
        groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
        longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(key)))
        group = upto(longs([g[0] for g in groups]))
        inner = F.array(*[longs(g) for g in groups])
        placed = F.when(group == 0, 0).otherwise((group - 1) * wide + upto(F.element_at(inner, F.greatest(group, F.lit(1)))))
    return F.when(F.col(key).isNull(), blocks + F.pmod(spare, F.lit(blocks))).otherwise(placed).cast("int")


def split(n_bytes: int) -> int:
    """Into how many blocks of documents, and as many parts of hashes, texts of so many bytes are dealt."""
    return max(1, -(-n_bytes // min(max(BLOCK_BYTES[0], int((n_bytes * PAIR_BYTES) ** 0.5)), BLOCK_BYTES[1])))


def substring_dedup(docs: DataFrame, words: int = 13) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_words, n_removed, removed (maximal intervals of words, from 0, end exclusive) and kept (the other
    words, joined by a space). A word is removed if a window of `words` words covers it whose words also start in a document of a smaller id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = parts = split(rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0)
    dealt = rows.withColumn("block", range_blocks(rows, "doc_id", blocks, F.xxhash64("text")))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        sent = list(Block(table, words, parts).sent())
        block = key[0].as_py()
        return pa.table(
            {"block": pa.array([block] * len(sent), pa.int32()), "part": pa.array([p for p, _ in sent], pa.int32()), "codes": pa.array([_planes(c) for _, c in sent], pa.binary())}
        )

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending")])
        block = np.minimum(table.column("block").to_numpy(), blocks)  # blocks without ids come last, and are equal
        codes = [_numbers(c) for c in table.column("codes").to_pylist()]
        sizes = [len(c) for c in codes]
        code, place = np.concatenate(codes), np.repeat(block, sizes)
        order = np.argsort(code, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = code[order[1:]] != code[order[:-1]]
        seen = np.empty(len(order), dtype=bool)
        seen[order] = place[order] > place[order[new]][np.cumsum(new) - 1]
        bits = [np.packbits(s).tobytes() for s in np.split(seen, np.cumsum(sizes)[:-1])]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "seen": pa.array(bits, pa.binary())})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, words, parts)
        earlier = np.zeros(len(block.codes), dtype=bool)
        for p, bits in zip(answers.column("part").to_pylist(), answers.column("seen").to_pylist(), strict=True):
            a, b = block.bounds[p], block.bounds[p + 1]
            earlier[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
        gone = block.covered(earlier)
        n_removed, spans, kept = [], [], []
        for text, a, n in zip(block.texts, block.firsts.tolist(), block.counts.tolist(), strict=True):
            own, left = gone[a : a + n], text.split()
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
            for x, y in reversed(edges):
                del left[x:y]
            n_removed.append(n - len(left))
            spans.append([{"start": x, "end": y} for x, y in edges])
            kept.append(b" ".join(left).decode())
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()), "n_words": pa.array(block.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.string()),
            }
        )

    sent = dealt.groupBy("block").applyInArrow(send, "block int, part int, codes binary")
    answers = sent.groupBy("part").applyInArrow(judge, "block int, part int, seen binary")
    out = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, out)
