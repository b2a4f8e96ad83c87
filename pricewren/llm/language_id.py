"""Language identification by prediction by partial matching.

For each language a context tree over bytes, of orders 0 to 3, is counted from labelled texts and then frozen. The probability of a byte
after its context is the byte's share of the context's counts (method C: the number of distinct successors is the weight of the escape); a
byte not seen after a context costs the escape and is predicted from the next shorter context, at last from a uniform byte. A text's score
in a language is its exact code length under that tree; the shortest wins.

Training takes about SAMPLE_BYTES bytes of whole texts for each language, and ALL_BYTES in all, chosen by a hash of the text: the share to take
follows from the languages' sizes, which are summed over all rows. Of more than LANGUAGES values of lang, those with most bytes are learned.
A model holds the contexts that were seen, in tables by language, so its size is bounded by the sample's. Scoring goes over every byte of
every text.

Defined results: a text that is null or holds no letter is `und` with score 0; ties go to the alphabetically first language; texts without
a language don't train, repeated rows train and are predicted each; without any trained language everything is `und`; no documents give no
rows. Only doc_id, text and lang are read, so other columns, of whatever name, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import frugal, unit_hash

ORDER = 3
#: Bounds of the training sample, for each language and in all; a language keeps one text at least.
SAMPLE_BYTES, ALL_BYTES = 4_000_000, 64_000_000
UNDETERMINED = "und"
#: Texts are scored in runs of about so many bytes at a time.
RUN_BYTES = 1 << 21


def _grams(data: np.ndarray) -> np.ndarray:
    """For each byte, it and the three bytes before it as one number; a text starts after three zero bytes."""
    b = np.concatenate([np.zeros(ORDER, dtype=np.uint32), data.astype(np.uint32)])
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of each four-byte gram by language, one row for each gram of a batch."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(_grams(np.frombuffer(text.encode(), dtype=np.uint8)))
        for lang, grams in by.items():
            g, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Table:
    """Numbers by 32-bit keys: found by hashing, a whole array of keys at a time; 0 for a key that isn't there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint32(32 - max(1, int(2 * len(keys)).bit_length()))
        slots = 1 << (32 - int(self.shift))
        self.keys, self.values, self.used = np.zeros(slots, dtype=np.uint32), np.zeros(slots, dtype=np.float32), np.zeros(slots, dtype=bool)
        self.steps, at = 0, self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # those that find their slot free take it, one for each slot; the others go on to the next
            self.steps += 1
            first = np.unique(at, return_index=True)[1]
            first = first[~self.used[at[first]]]
            self.keys[at[first]], self.values[at[first]], self.used[at[first]] = keys[left[first]], values[left[first]], True
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and which keys are there."""
        at = self._slot(keys)
        there = self.used[at] & (self.keys[at] == keys)
        out = np.where(there, self.values[at], np.float32(0))
        left = np.flatnonzero(~there & self.used[at])
        for _ in range(1, self.steps):
            if not len(left):
                break
            spot = (at[left] + 1) & (len(self.keys) - 1)
            at[left] = spot
            hit = self.used[spot] & (self.keys[spot] == keys[left])
            out[left[hit]], there[left[hit]] = self.values[spot[hit]], True
            left = left[~hit & self.used[spot]]
        return out, there


class Tree:
    """The frozen context tree of one language as tables of code lengths in bits: of bytes in full by contexts of up to one byte, of seen bytes and
    of escapes after contexts of two and three."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        grams = grams.astype(np.uint32)
        length = np.full((1, 256), 8.0)  # order -1: a uniform byte
        for order in (0, 1):
            total = np.bincount((grams & np.uint32((1 << 8 * order + 8) - 1)).astype(np.int64), weights=n, minlength=256 ** (order + 1)).reshape(-1, 256)
            sums, kinds = total.sum(axis=1, keepdims=True), (total > 0).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(sums > 0, np.log2((sums + kinds) / np.maximum(kinds, 1)), 0.0)
                length = np.where(total > 0, np.log2((sums + kinds) / total), escape + length)
        self.low = length.astype(np.float32).ravel()
        self.seen, self.escape = [], []
        for order in (2, 3):
            key, place = np.unique(grams & np.uint32((1 << 8 * order + 8) - 1), return_inverse=True)
            count = np.bincount(place, weights=n)
            context, row = np.unique(key >> np.uint32(8), return_inverse=True)
            sums, kinds = np.bincount(row, weights=count), np.bincount(row)
            self.seen.append(Table(key, np.log2((sums + kinds)[row] / count)))
            self.escape.append(Table(context, np.log2((sums + kinds) / kinds)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each gram after the three before it."""
        out, there = self.seen[1].find(grams)
        left = np.flatnonzero(~there)
        g = grams[left]
        shorter, there = self.seen[0].find(g & np.uint32(0xFFFFFF))
        least = np.flatnonzero(~there)
        shorter[least] = self.escape[0].find(g[least] >> np.uint32(8) & np.uint32(0xFFFF))[0] + self.low[(g[least] & np.uint32(0xFFFF)).astype(np.int64)]
        out[left] = self.escape[1].find(g >> np.uint32(8))[0] + shorter
        return out


class LanguageModel:
    """Frozen context trees of several languages. What is shared with executors are the counts; the tables are built once in each process."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.counts = {lang: (grams.astype(np.uint32), n.astype(np.uint32)) for lang, (grams, n) in counts.items()}
        self._trees: list[Tree] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trees": None}

    @property
    def trees(self) -> list[Tree]:
        if self._trees is None:
            self._trees = [Tree(*self.counts[lang]) for lang in self.languages]
        return self._trees

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits for each text and language."""
        out = np.zeros((len(texts), len(self.languages)))
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= RUN_BYTES):
                size += len(texts[end])
                end += 1
            for i in range(start, end) if end - start == 1 else ():
                self._long(texts[i], out[i])
            if end - start > 1:
                grams = np.concatenate([_grams(np.frombuffer(t, dtype=np.uint8)) for t in texts[start:end]])
                of = np.repeat(np.arange(end - start), [len(t) for t in texts[start:end]])
                for j, tree in enumerate(self.trees):
                    out[start:end, j] = np.bincount(of, weights=tree.bits(grams), minlength=end - start)
            start = end
        return out

    def _long(self, text: bytes, out: np.ndarray) -> None:
        """The bits of one text, by runs."""
        data = np.frombuffer(b"\0\0\0" + text, dtype=np.uint8)
        for at in range(0, len(text), RUN_BYTES):
            b = data[at : at + RUN_BYTES + ORDER].astype(np.uint32)
            grams = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
            for j, tree in enumerate(self.trees):
                out[j] += tree.bits(grams).sum(dtype=np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and the share of its probability among all languages."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        bits = self.code_lengths([texts[i].encode() for i in some])
        for i, b in zip(some, bits, strict=True):
            best = int(b.argmin())
            names[i] = self.languages[best]
            scores[i] = float(1 / np.exp2(np.clip(b[best] - b, -1000, 0)).sum())
        return names, scores


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, all_bytes: int = ALL_BYTES, seed: int = 9) -> LanguageModel:
    """A model of docs(lang, text) with all their languages. What reaches the driver are one row for each language, and the counts of a sample of about
    all_bytes bytes: languages have equal shares of it, and each at least the text whose hash is least."""
    drawn = unit_hash(F.col("text"), seed=seed)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", drawn.alias("drawn"))
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min(F.when(F.octet_length("text") > 0, F.col("drawn"))).alias("least")).where("n > 0").collect()
    if not sizes:
        return LanguageModel({})
    most = min(sample_bytes, all_bytes // len(sizes))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["n"]), r["least"]) for r in sizes], "lang string, share double, least double")
    sample = labelled.join(F.broadcast(shares), "lang").where("drawn < share or drawn = least").select("lang", "text")  # a row for each language
    rows = sample.mapInArrow(frugal(_count_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = {}
    langs, grams, n = rows.column("lang").to_numpy(zero_copy_only=False), rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    for lang in sorted(set(langs)):
        of = langs == lang
        counts[str(lang)] = (grams[of], n[of])
    return LanguageModel(counts)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 8 bytes for each byte of the training sample

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(score), "doc_id long, lang_pred string, score double")
