"""Alignment of two tokenizers' tokens by byte offsets, and how common the aligned pairs are in the corpus.

Tokenizer A (byte-level BPE, of the tokenizers library) encodes a space and the text, tokenizer B (sentencepiece BPE with byte fallback) the text, before
which it puts that space itself. Where both have a token's end at the same byte, a group ends and the tokens that end there are linked.

Texts are cut before each run of spaces that follows another character. Neither tokenizer has a token across such a cut (B's vocabulary is searched
for one, A's rules are compared with the known ones), so the ids of the stretches, one behind the other, are those of the text, every cut is a common end, and a stretch
that recurs is aligned once. A vocabulary without this property is aligned by whole texts.

A run of documents becomes one row of their counts and, for each part of B's ids, one row of postings: pairs, documents and multiplicities in sorted order.
Both are written once. Counts of pairs are summed over runs, and the greatest of each B id is found among its pairs. Postings and counts then meet by part in
a cogroup; a part with many postings is dealt to as many groups as its bytes need, each with the part's counts. Each posting row gives its
documents' contributions, which are summed by document within the run. What is held at once is a run, or a group of bounded bytes and a part of the distinct pairs,
whose number the vocabularies bound.

Defined results: texts that are null or empty, or whose tokens' bytes under A or B are not those of the space and the text, have no tokens: zeros, and '' for
the groups; ties for the greatest count are all best; repeated rows count as texts of their own; a null doc_id stays null; no documents give no rows. Only
doc_id and text are read, so other columns, of whatever name, don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.llm.common import Written, frugal, shuffle_partitions
from pricewren.llm.tokens import slices

SPACE = "▁"
#: A stretch: spaces, then other characters; the last one takes the spaces at the text's end.
_STRETCH = re.compile(r" +[^ ]+(?: +\Z)?| +\Z")
#: What a worker remembers: so many stretches, of so many characters in all.
STRETCHES, LETTERS = 300_000, 24 << 20
#: Parts of B's ids for each shuffle partition, and bytes of postings that one group takes.
SPREAD, GROUP_BYTES = 2, 32 << 20
#: The lower bits of a pair's code hold A's id.
A_BITS = 32

RUN_SCHEMA = (
    "run long, part int, codes binary, sizes binary, docs binary, times binary, pairs array<long>, totals array<long>, "
    "doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, groups_sha256 array<string>"
)


def _shown_bytes() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable Latin-1 for itself, the others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = _shown_bytes()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = {i: special[i] if i in special else bytes(shown[c] for c in t) for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, dtype=np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(b) for b in self.a_bytes.values()]
        self.b_sizes = np.array([len(b) for b in self.b_bytes], dtype=np.int64)
        self.most = max(len(self.a_sizes), len(self.b_sizes))
        self.numbers = np.array([f"{i}{sign}" for sign in (",", "|", ";", "\n") for i in range(self.most)], dtype=object)
        with open(a_path, encoding="utf-8") as f:
            rules = json.load(f)
        split = rules.get("pre_tokenizer") or {}
        self.cuts = (
            (split.get("type"), split.get("add_prefix_space"), split.get("use_regex"), rules.get("normalizer")) == ("ByteLevel", False, True, None)
            and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        )
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.shape: list[tuple[int, int, int, bool]] = []  # of each stretch: tokens of A and of B, links, whether it is broken
        self.texts: list[str] = []  # its groups
        self.links: list[int] = []  # all stretches' links, one behind the other

    def _learn(self, stretches: list[str]) -> None:
        """Align stretches, all in one go: ends of tokens are places in the stretches laid one behind the other."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] for s in stretches], num_threads=1)
        data = [s.encode() for s in stretches]
        whole = b"".join(data)
        joined = [b"".join([table[i] for ids in side for i in ids]) for side, table in ((ids_a, self.a_bytes), (ids_b, self.b_bytes))]
        broken = np.zeros(len(stretches), dtype=bool)
        if not joined[0] == joined[1] == whole:
            for k, (d, xs, ys) in enumerate(zip(data, ids_a, ids_b, strict=True)):
                broken[k] = not b"".join([self.a_bytes[x] for x in xs]) == b"".join([self.b_bytes[y] for y in ys]) == d
            for k in np.flatnonzero(broken).tolist():
                ids_a[k], ids_b[k], data[k] = [], [], b""
        n_a, n_b, size = (np.fromiter(map(len, xs), dtype=np.int64, count=len(xs)) for xs in (ids_a, ids_b, data))
        xs, ys = (np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_x, ends_y, ends = np.cumsum(self.a_sizes[xs]), np.cumsum(self.b_sizes[ys]), np.cumsum(size)
        common = np.intersect1d(ends_x, ends_y, assume_unique=True)
        n_links = np.diff(np.searchsorted(common, np.concatenate([[0], ends]), side="right"))
        self.links.extend((ys[np.isin(ends_y, common, assume_unique=True)] << A_BITS | xs[np.isin(ends_x, common, assume_unique=True)]).tolist())
        # The groups as text: A's tokens and B's tokens of each group in turn, with the sign that stands behind each.
        key = np.concatenate([2 * np.searchsorted(common, ends_x), 2 * np.searchsorted(common, ends_y) + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        last = np.ones(len(key), dtype=bool)
        last[:-1] = key[1:] != key[:-1]
        stops = np.isin(common, ends)[key >> 1]
        sign = np.where(~last, 0, np.where(key & 1 == 0, 1, np.where(stops, 3, 2)))
        shown = "".join(self.numbers[sign * self.most + np.concatenate([xs, ys])[order]].tolist()).split("\n")[:-1]
        at = iter(shown)
        self.texts.extend("" if b or not n else next(at) for b, n in zip(broken.tolist(), n_links.tolist(), strict=True))
        self.shape.extend(zip(n_a.tolist(), n_b.tolist(), n_links.tolist(), broken.tolist(), strict=True))
        first = len(self.known)
        self.known.update(zip(stretches, range(first, first + len(stretches)), strict=True))
        self.letters += sum(map(len, stretches))

    def run(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For texts: their numbers of tokens of A, of B and of links (rows of an array), their groups' digests, and all links' codes and texts."""
        cut = [([] if not t else _STRETCH.findall(" " + t) if self.cuts else [" " + t]) for t in texts]
        if len(self.known) > STRETCHES or self.letters > LETTERS:
            self.forget()
        if new := list({s for c in cut for s in c} - self.known.keys()):
            self._learn(new)
        index = self.known.__getitem__
        kinds = [list(map(index, c)) for c in cut]
        sizes = np.array([len(k) for k in kinds], dtype=np.int64)
        kind = np.array([k for ks in kinds for k in ks], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        shape = np.array(self.shape, dtype=np.int64).reshape(-1, 4)
        sums = np.stack([np.bincount(owner, weights=shape[kind, i], minlength=len(texts)).astype(np.int64) for i in range(4)])
        good = (sums[3] == 0) & (sizes > 0)
        digests = [hashlib.sha256(";".join([self.texts[k] for k in ks]).encode()).hexdigest() if g else "" for ks, g in zip(kinds, good.tolist(), strict=True)]
        kept = good[owner]
        kind, owner = kind[kept], owner[kept]
        n = shape[kind, 2]
        ends = np.cumsum(shape[:, 2])
        first = (ends - shape[:, 2])[kind]
        last = np.cumsum(n)
        places = np.repeat(first - (last - n), n) + np.arange(last[-1] if len(last) else 0)
        return sums[:3] * good, digests, np.array(self.links, dtype=np.int64)[places], np.repeat(owner, n)


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _part(b_ids: np.ndarray, parts: int) -> np.ndarray:
    return ((b_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _postings(codes: np.ndarray, docs: np.ndarray, parts: int) -> Iterator[tuple[int, list]]:
    """For each part, the run's pairs in order: codes, number of documents of each, documents, multiplicities, and totals."""
    order = np.lexsort((docs, codes, _part(codes >> A_BITS, parts)))
    codes, docs = codes[order], docs[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(codes)))
    codes, docs = codes[at], docs[at]
    part = _part(codes >> A_BITS, parts)
    bounds = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        own = slice(bounds[p], bounds[p + 1])
        c, d, t = codes[own], docs[own], times[own]
        lead = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(np.append(lead, len(c)))
        yield p, [c[lead].tobytes(), sizes.astype("<u4").tobytes(), d.astype("<u4").tobytes(), t.astype("<u4").tobytes(), c[lead], np.add.reduceat(t, lead)]


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair's count is the greatest of its B id),
    count_sum (of the pairs' counts over the links) and groups_sha256 (of the groups as text). Paths are those of tokenizers on each executor."""
    spark = docs.sparkSession
    write = Written(spark)
    parts = SPREAD * shuffle_partitions(spark)

    @frugal
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            for at, n in slices(batch.column("text")):
                own = batch.slice(at, n)
                (n_a, n_b, n_links), digests, codes, owner = aligner.run(own.column("text").to_pylist())
                run = uuid.uuid4().int >> 65
                rows = [[run, p, *cols, *[None] * 5] for p, cols in _postings(codes, owner, parts)]
                rows.append([run, None, *[None] * 6, own.column("doc_id"), n_a, n_b, n_links, digests])
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 6, pa.list_(pa.string())]
                names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
                for some in ([r for r in rows[:-1]], rows[-1:]):
                    if some:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    runs = write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, RUN_SCHEMA), "aligned")
    postings = runs.where("part is not null")
    counted = postings.select("part", F.explode(F.arrays_zip("pairs", "totals")).alias("pair")).groupBy("part", F.col("pair.pairs").alias("code")).agg(F.sum("pair.totals").alias("total"))
    side = Window.partitionBy(F.shiftright("code", A_BITS))
    counts = write(counted.select("part", "code", "total", (F.col("total") == F.max("total").over(side)).alias("best")), "pairs")
    groups = postings.groupBy("part").agg(F.ceil(F.sum(F.octet_length("docs") + F.octet_length("times")) / GROUP_BYTES).cast("int").alias("groups"))
    groups = F.broadcast(groups)  # one row for each part
    dealt = postings.select("run", "part", "codes", "sizes", "docs", "times").join(groups, "part").withColumn("salt", F.pmod(F.xxhash64("run"), F.greatest("groups", F.lit(1))).cast("int")).drop("groups")
    copied = counts.join(groups, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest("groups", F.lit(1)) - 1))).drop("groups")
    parted = dealt.groupBy("part", "salt").cogroup(copied.groupBy("part", "salt")).applyInArrow(_contributions, "run long, docs binary, sums binary, bests binary")
    shown = runs.where("part is null").select("run", "doc_id", "n_a", "n_b", "n_links", "groups_sha256")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return shown.groupBy("run").cogroup(parted.groupBy("run")).applyInArrow(_summed, out)


def _contributions(postings: pa.Table, counts: pa.Table) -> pa.Table:
    """Of each row of postings: its documents, the sums of their pairs' counts, and their links of best pairs."""
    counts = counts.sort_by("code")
    code, total, best = (counts.column(c).to_numpy() for c in ("code", "total", "best"))
    rows = []
    for batch in postings.to_batches():
        for run, *data in zip(*(batch.column(c).to_pylist() for c in ("run", "codes", "sizes", "docs", "times")), strict=True):
            codes = np.frombuffer(data[0], dtype=np.int64)
            sizes, docs, times = (np.frombuffer(d, dtype="<u4").astype(np.int64) for d in data[1:])
            at = np.repeat(np.searchsorted(code, codes), sizes)
            sums, bests = np.zeros((2, int(docs.max()) + 1), dtype=np.int64)
            np.add.at(sums, docs, times * total[at])
            np.add.at(bests, docs, times * best[at])
            some = np.flatnonzero(sums)
            rows.append((run, some.astype("<u4").tobytes(), sums[some].tobytes(), bests[some].astype("<u4").tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("run", "docs", "sums", "bests"), columns, (pa.int64(), *[pa.binary()] * 3), strict=True)})


def _summed(shown: pa.Table, parted: pa.Table) -> pa.Table:
    """A run's documents, with what all parts contribute to them."""
    columns = {c: shown.column(c).combine_chunks().flatten() for c in ("doc_id", "n_a", "n_b", "n_links", "groups_sha256")}
    sums, bests = np.zeros((2, len(columns["doc_id"])), dtype=np.int64)
    for docs, s, b in zip(*(parted.column(c).to_pylist() for c in ("docs", "sums", "bests")), strict=True):
        at = np.frombuffer(docs, dtype="<u4")
        sums[at] += np.frombuffer(s, dtype=np.int64)
        bests[at] += np.frombuffer(b, dtype="<u4")
    return pa.table({"doc_id": columns["doc_id"], "n_a": columns["n_a"], "n_b": columns["n_b"], "n_groups": columns["n_links"], "n_links": columns["n_links"], "n_best": pa.array(bests), "count_sum": pa.array(sums), "groups_sha256": columns["groups_sha256"]})
