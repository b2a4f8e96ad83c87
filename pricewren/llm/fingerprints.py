"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every window of five bytes gives three triplets; each is hashed into one of 256 buckets. The digest holds, for each bucket, the quartile
its count falls in (two bits), and in front the length of the text on a logarithmic scale and the ratios of the quartiles.

Defined results: null text counts as empty; a text of under five bytes has no triplets and differs by its length alone; equal texts have
equal digests; comparing a digest with itself gives 1; repeated rows follow each other; texts of any length are digested in whole; no documents
give no rows. Only doc_id and text are read, so other columns, of whatever name, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import shuffle_partitions

BUCKETS = 256
#: Offsets of the three bytes of each triplet in a window of five.
TRIPLETS = ((0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Body difference at which two digests count as wholly unlike: about what independent bucket counts give.
UNLIKE = 300.0


def _table(name: str) -> np.ndarray:
    return np.array([hashlib.sha256(f"{name}:{i}".encode()).digest()[0] for i in range(256)], dtype=np.uint8)


_TABLES = [[_table(f"{k}-{j}") for j in range(3)] for k in range(len(TRIPLETS))]


def triplet_counts(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for (i, j, k), (ti, tj, tk) in zip(TRIPLETS, _TABLES, strict=True):
        n = len(b) - k
        if n > 0:
            counts += np.bincount(ti[b[i : n + i]] ^ tj[b[j : n + j]] ^ tk[b[k:]], minlength=BUCKETS)
    return counts


def digest(data: bytes) -> np.ndarray:
    """Length, two quartile ratios, then one quartile number (0 to 3) for each bucket."""
    counts = triplet_counts(data)
    q1, q2, q3 = np.partition(counts, (63, 127, 191))[[63, 127, 191]]
    out = np.empty(3 + BUCKETS, dtype=np.uint8)
    out[0] = min(255, round(8 * np.log2(1 + len(data))))
    out[1], out[2] = (15 * q1 // q3, 15 * q2 // q3) if q3 else (0, 0)
    out[3:] = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    return out


def to_text(d: np.ndarray) -> str:
    codes = d[3:].reshape(-1, 4)
    body = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return f"{d[0]:02x}{d[1]:x}{d[2]:x}{body.astype(np.uint8).tobytes().hex()}"


def from_text(text: str) -> np.ndarray:
    body = np.frombuffer(bytes.fromhex(text[4:]), dtype=np.uint8)
    codes = np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=1).ravel()
    return np.concatenate([np.array([int(text[:2], 16), int(text[2], 16), int(text[3], 16)], dtype=np.uint8), codes])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, down to 0; a and b hold digests in rows."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    body = d[:, 3:]
    difference = body.sum(axis=1) + 3 * (body == 3).sum(axis=1)  # opposite ends count double
    header = 2.0 * np.maximum(0, d[:, 0] - 2) + d[:, 1] + d[:, 2]
    return np.clip(1 - (difference + header) / UNLIKE, 0.0, 1.0)


def in_order_blocks(docs: DataFrame, key: str, blocks: int) -> DataFrame:
    """docs in about `blocks` ranges of `key`, each range with the first row of the next one (tail = true) behind its own rows.

    Columns block and tail are added. The range bounds and first keys are the only values that reach the driver: one for each block. The
    last block is followed by the first row of all. Null keys come first.
    """
    spark = docs.sparkSession
    at = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(docs.agg(F.percentile_approx(key, at, 20 * blocks).alias("b")).first()["b"] or [])) if at else []
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    if bounds:
        kind = docs.schema[key].dataType
        longs = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs])
        top, inner = longs([g[0] for g in groups]), F.array(*[longs(g) for g in groups])
        upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(key)))
        group = upto(top)
        block = F.when(F.col(key).isNull() | (group == 0), 0).otherwise((group - 1) * wide + upto(F.element_at(inner, group)))
    else:
        block = F.lit(0)
    firsts = sorted(
        (r["block"], r["first"], r["nulls"])
        for r in docs.select(block.cast("int").alias("block"), key).groupBy("block").agg(F.min(key).alias("first"), F.count_if(F.col(key).isNull()).alias("nulls")).collect()
    ) if bounds else []
    placed = docs.withColumn("block", block.cast("int"))
    own = F.struct("block", F.lit(False).alias("tail"))
    if not firsts:
        copies = F.array(own, F.struct("block", F.lit(True).alias("tail")))  # one block: each row may be the first
    else:
        prior = F.create_map(*[F.lit(x) for i, (b, _, _) in enumerate(firsts) for x in (b, firsts[i - 1][0])])
        is_first = F.col(key).isin([f for _, f, nulls in firsts if not nulls])
        if firsts[0][2]:
            is_first = F.col(key).isNull() | F.coalesce(is_first, F.lit(False))
        copies = F.when(is_first, F.array(own, F.struct(prior[F.col("block")].alias("block"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    return placed.withColumn("copy", F.explode(copies)).select(*docs.columns, "copy.block", "copy.tail")


def neighbour_digests(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): its digest, that of the text whose last quarter is replaced by the start of the next document,
    and the likeness of its digest to both of the others'.

    The next document is the one of the next larger doc_id (equal ids in order of text), and the first one after the last. Null doc_ids come
    first; with a single row, the next document is that row itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    blocks = in_order_blocks(rows, "doc_id", n)
    dealt = blocks.repartitionById(n, F.col("block")).sortWithinPartitions("block", "tail", "doc_id", "text")
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_neighbours, out)


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of block, tail, doc_id; each row is compared with the one behind it in its block."""
    pending = None  # (block, tail, doc_id, text, digest)
    for batch in batches:
        ids, texts, blocks, tails = (batch.column(c).to_pylist() for c in ("doc_id", "text", "block", "tail"))
        out: list[list] = [[] for _ in range(5)]
        own, edits, nexts = [], [], []
        for doc_id, text, block, tail in zip(ids, texts, blocks, tails, strict=True):
            if tail and (pending is None or pending[0] != block or pending[1]):
                continue  # only the first row behind a block's own rows counts
            row = (block, tail, doc_id, text, digest(text.encode()))
            if pending is not None and pending[0] == block:
                _, _, before, old, d = pending
                n = len(old)
                edited = (old[: n - n // 4] + text[: n // 4]).encode()
                e = digest(edited)
                for column, x in zip(out, (before, n, hashlib.sha256(edited).hexdigest(), to_text(d), to_text(e)), strict=True):
                    column.append(x)
                own.append(d)
                edits.append(e)
                nexts.append(row[4])
            pending = row
        if own:
            a = np.stack(own)
            near = [likeness(a, np.stack(x)) for x in (edits, nexts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.string()) for x in out[2:]), *(pa.array(x, pa.float64()) for x in near)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
