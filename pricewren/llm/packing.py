"""Packing documents into sequences of a fixed window by non-negative least squares.

A document of at least a window's tokens fills whole sequences by itself; what counts is its remainder (length mod window). The remainders'
histogram is solved for: shallow combinations of lengths that fill a window exactly (pairs, triples and quadruples) are enumerated,
non-negative least squares gives how often to repeat each, and the numbers are rounded to what the histogram holds. Residual lengths are
packed greedily, largest first, into exact fills; what then is left is laid end to end, in order of length, and cut at the window's bounds.
The last open stretch is cut into powers of two, which need no padding. So no sequence is padded, and few documents are cut.

The plan is worked out over the histogram, at most `window` numbers, and holds a bounded number of combinations; documents meet it by their
rank within their length, counted in salted groups, so a length that very many documents share is no hot key.

Documents that are cut are tokenized a second time, for the checksums of their pieces; they are found again by 128 bits of hashes of id and
text, so that two documents would have to share both hashes to be mixed up.

Defined results: null and empty texts have the end token alone; repeated rows are documents of their own, a null doc_id stays null; texts
of any length are cut into windows; lengths that many documents share are taken in any order; no documents give no pieces. Only doc_id and
text are read, so other columns, of whatever name, don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.llm.common import frugal, shuffle_partitions, written
from pricewren.llm.tokens import ENCODED_BYTES, encoder, slices

#: Least and greatest number of groups that the documents of one length are counted in; in between, one for each shuffle partition.
SALTS = (64, 1024)
#: Combinations enumerated for each length, by number of members.
TRIPLES, QUADRUPLES = 6, 3
STEPS = 400
FILTER_BITS = 1 << 21

Batches = Iterable[pa.RecordBatch]


def combinations(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of occurring lengths (descending) that add up to the window: all pairs, and for each length some spread triples and quadruples."""
    some = np.flatnonzero(histogram[:window])
    some = some[some > 0]
    there = histogram > 0
    found: set[tuple[int, ...]] = set()
    for a in some.tolist():
        b = window - a
        if b >= a and there[b]:
            found.add((b, a))
        for parts, spread in ((2, TRIPLES), (3, QUADRUPLES)):
            rest = window - a
            for k in range(1, spread + 1):
                members, left = [a], rest
                for p in range(parts, 1, -1):
                    aim = left * k / (spread + 1) if p == 2 else left / p * (0.6 + 0.8 * k / (spread + 1))
                    near = some[np.searchsorted(some, aim) % len(some)]
                    if near >= left:
                        break
                    members.append(int(near))
                    left -= int(near)
                else:
                    if left > 0 and there[left]:
                        found.add(tuple(sorted([*members, left], reverse=True)))
    return sorted(found, reverse=True)


def repeats(histogram: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts by non-negative least squares against the histogram (accelerated projected gradient), rounded down to what is there."""
    if not combos:
        return np.zeros(0, dtype=np.int64)
    depth = max(map(len, combos))
    rows = np.zeros((len(combos), depth), dtype=np.int64)  # length 0 stands for no member
    for i, c in enumerate(combos):
        rows[i, : len(c)] = c
    h = histogram.astype(np.float64)
    h[0] = 0
    used = lambda x: np.bincount(rows.ravel(), weights=np.repeat(x, depth), minlength=len(h))
    degree = np.bincount(rows.ravel(), minlength=len(h)).astype(np.float64)
    degree[0] = 0
    step = 1.0 / np.maximum((degree[rows] * (rows > 0)).max(axis=1) * depth, 1)  # a safe step for each combination
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(STEPS):
        miss = used(y) - h
        miss[0] = 0
        new = np.maximum(0, y - step * miss[rows].sum(axis=1))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    counts = np.floor(x).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for i in np.argsort(-x, kind="stable"):
        member, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        most = int((left[member] // times).min())
        counts[i] = min(int(counts[i]), most)
        left[member] -= times * counts[i]
    for i in np.argsort(-(x - np.floor(x)), kind="stable"):  # round up while the histogram allows it
        member, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        if (left[member] >= times).all():
            counts[i] += 1
            left[member] -= times
    return counts


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact fills out of the residual histogram (which is used up in place): largest length first, completed by the largest that fit."""
    out = []
    for a in range(window - 1, 0, -1):
        while left[a] > 0:
            members, rest = [a], window - a
            left[a] -= 1
            taken = {a: 1}
            while rest:
                fit = np.flatnonzero(left[: rest + 1])
                fit = fit[fit > 0]
                if not len(fit):
                    break
                exact = rest if left[rest] else int(fit[-1])
                if len(members) < 6 and not left[rest]:  # rather a member whose complement is there too
                    pairs = fit[(left[rest - fit] > 0) & ((2 * fit != rest) | (left[fit] > 1)) & (fit < rest)]
                    exact = int(pairs[-1]) if len(pairs) else exact
                members.append(exact)
                left[exact] -= 1
                taken[exact] = taken.get(exact, 0) + 1
                rest -= exact
            if rest:  # no exact fill: put everything back and leave this length to be cut
                for m, n in taken.items():
                    left[m] += n
                break
            more = min(int(left[m] // n) for m, n in taken.items())
            for m, n in taken.items():
                left[m] -= n * more
            out.append((tuple(members), 1 + more))
    return out


class Plan:
    """Where the k-th document of each remainder length goes. Sequences are numbered from `first` on."""

    def __init__(self, histogram: np.ndarray, window: int, first: int = 0):
        self.window = window
        combos = combinations(histogram, window)
        counts = repeats(histogram, combos)
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        fills = []
        for c, n in zip(combos, counts.tolist(), strict=True):
            if n:
                fills.append((c, n))
                for m in c:
                    left[m] -= n
        fills += greedy(left, window)
        slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: number of documents, first sequence, offset
        sequence = first
        for members, n in fills:
            offset = 0
            for m in members:
                slots.setdefault(m, []).append((n, sequence, offset))
                offset += m
            sequence += n
        self.slots = {}
        for length, entries in slots.items():
            n, base, offset = (np.array(x, dtype=np.int64) for x in zip(*entries, strict=True))
            self.slots[length] = (np.cumsum(n) - n, base, offset)
        self.whole = histogram.astype(np.int64) - left  # documents of each length that are packed uncut
        self.whole[0] = 0
        sizes = left * np.arange(len(left))
        order = np.arange(len(left))[::-1]  # largest lengths first
        before = np.cumsum(sizes[order]) - sizes[order]
        self.stream = np.zeros(len(left), dtype=np.int64)
        self.stream[order] = before
        total = int(sizes.sum())
        self.stream_first, self.stream_windows = sequence, total // window
        tail, self.tail = total % window, []  # (start, sequence) of the last stretch's powers of two
        at, sequence = total - tail, sequence + total // window
        while tail:
            p = 1 << (tail.bit_length() - 1)
            self.tail.append((at, sequence))
            at, sequence, tail = at + p, sequence + 1, tail - p
        self.total, self.sequences = total, sequence

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """The pieces (start, length, sequence, offset) of the document of this rank among those of its length."""
        if not length:
            return []
        if rank < self.whole[length]:
            starts, base, offset = self.slots[length]
            i = int(np.searchsorted(starts, rank, side="right")) - 1
            return [(0, length, int(base[i]) + rank - int(starts[i]), int(offset[i]))]
        at = int(self.stream[length]) + (rank - int(self.whole[length])) * length
        end, begin, out = at + length, at, []
        while at < end:
            if at < self.stream_windows * self.window:
                w = at // self.window
                start, sequence, stop = w * self.window, self.stream_first + w, (w + 1) * self.window
            else:
                i = max(j for j, (s, _) in enumerate(self.tail) if s <= at)
                start, sequence = self.tail[i]
                stop = self.tail[i + 1][0] if i + 1 < len(self.tail) else self.total
            n = min(stop, end) - at
            out.append((at - begin, n, sequence, at - start))
            at += n
        return out


def _encoded(path: str, end_id: int, window: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Batches) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for at, n in slices(batch.column("text"), ENCODED_BYTES):
                part = batch.slice(at, n)
                ids = [x + end for x in tokens.encode(part.column("text"))]
                sums = [[zlib.crc32(x[i : i + 4 * window]) for i in range(0, len(x), 4 * window)] for x in ids]  # of the pieces of an uncut document
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key", "key2")), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "key", "key2", "doc_tokens", "sums"])

    return encode


def _pieces(plan, firsts, window: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Rows: a document's remainder length, salt, rank and the number of whole windows before it in its salted group."""
    names = ["doc_id", "key", "key2", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64()] * len(names)

    def pieces(batches: Batches) -> Iterator[pa.RecordBatch]:
        p, (ranks, windows) = plan.value, firsts.value
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, key2, tokens, sums, salt, rank, before in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "key2", "doc_tokens", "sums", "salt", "rank", "before")), strict=True):
                full, rest = divmod(tokens, window)
                first = int(windows[rest, salt]) + before
                out += [(doc_id, key, key2, i * window, window, sums[i], tokens, first + i, 0) for i in range(full)]
                parts = p.place(rest, int(ranks[rest, salt]) + rank)
                out += [(doc_id, key, key2, full * window + s, n, sums[full] if len(parts) == 1 else None, tokens, q, o) for s, n, q, o in parts]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return pieces


def _wanted_ids(path: str, end_id: int, wanted) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Batches) -> Iterator[pa.RecordBatch]:
        tokens, bits = encoder(path), wanted.value
        for batch in batches:
            keys = batch.column("key").to_numpy()
            hit = np.flatnonzero(bits[keys & (FILTER_BITS - 1)])
            wanted_rows = batch.take(pa.array(hit))
            for at, n in slices(wanted_rows.column("text"), ENCODED_BYTES):
                part = wanted_rows.slice(at, n)
                ids = [x + end for x in tokens.encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("key2"), pa.array(ids, pa.binary())], names=["key", "key2", "ids"])

    return encode


def _summed(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [zlib.crc32(x[4 * s : 4 * (s + n)]) for x, s, n in zip(batch.column("ids").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist(), strict=True)]
        columns = {c: batch.column(c) for c in ("doc_id", "start", "length")} | {"ids_crc32": pa.array(sums, pa.int64())} | {c: batch.column(c) for c in ("doc_tokens", "sequence_id", "offset")}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """A row for each piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. tokenizer_path is a path on each executor."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(10), "doc_id", "text").alias("key"), F.xxhash64(F.lit(11), "text", "doc_id").alias("key2"), "text")
    sized = rows.mapInArrow(frugal(_encoded(tokenizer_path, end_id, window)), "doc_id long, key long, key2 long, doc_tokens long, sums array<long>")
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    salts = min(max(SALTS[0], shuffle_partitions(spark)), SALTS[1])
    rest, salt = (F.col("doc_tokens") % window).cast("int"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    keyed = sized.withColumn("rest", rest).withColumn("salt", salt).withColumn("full", F.floor(F.col("doc_tokens") / window))
    groups = keyed.groupBy("rest", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("full")).toArrow()  # at most window * SALTS[1] rows
    n, full = np.zeros((window, salts), dtype=np.int64), np.zeros((window, salts), dtype=np.int64)
    at = groups.column("rest").to_numpy(), groups.column("salt").to_numpy()
    n[at], full[at] = groups.column("n").to_numpy(), groups.column("full").to_numpy()
    ranks = np.cumsum(n, axis=1) - n
    windows = (np.cumsum(full) - full.ravel()).reshape(full.shape)
    context = spark.sparkContext
    plan = context.broadcast(Plan(n.sum(axis=1), window, int(full.sum())))
    order = Window.partitionBy("rest", "salt").orderBy("row")
    ranked = keyed.withColumn("rank", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = "doc_id long, key long, key2 long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = written(ranked.select("doc_id", "key", "key2", "doc_tokens", "sums", "salt", "rank", "before").mapInArrow(frugal(_pieces(plan, context.broadcast((ranks, windows)), window)), out), "pieces")
    uncut, cut = placed.where("ids_crc32 is not null").drop("key", "key2"), placed.where("ids_crc32 is null")
    cells = cut.select(F.col("key").bitwiseAND(FILTER_BITS - 1).cast("int").alias("cell")).distinct().toArrow().column("cell").to_numpy()  # at most FILTER_BITS numbers
    if not len(cells):
        return uncut
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bits[cells] = True
    ids = rows.mapInArrow(frugal(_wanted_ids(tokenizer_path, end_id, context.broadcast(bits))), "key long, key2 long, ids binary")
    ids = ids.join(cut.select("key", "key2").distinct(), ["key", "key2"], "left_semi").groupBy("key", "key2").agg(F.any_value("ids").alias("ids"))  # equal keys have equal ids
    return uncut.unionByName(cut.join(ids, ["key", "key2"]).drop("key", "key2").mapInArrow(frugal(_summed), uncut.schema))
