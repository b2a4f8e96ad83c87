"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters of other scripts, digits and signs standing for letters), everything but letters and digits
becomes one space, and an Aho-Corasick automaton finds the lexicon's entries: whole words, word beginnings and exception phrases. A word
counts once, with its heaviest entry; a word inside an exception phrase doesn't count. The sum of the weights, normalised by a power of the
number of words, goes through a logistic curve.

Entries, weights, exception phrases, the power and the curve are learned from labelled texts: weights are log odds of the shares of toxic
and other texts that hold the entry. Training takes at most SAMPLE_ROWS rows of each label, chosen by a hash of doc_id; the rates follow from the label
counts of all rows. Copies of a text train once.

Defined results: null and empty texts have no entries and get the score of a text without any; without labels of both kinds every score
is the share of toxic labels (0 without labels). A doc_id with labels of both kinds is toxic, and so is a text that is labelled both ways;
a score of just 0.5 counts as toxic. Repeated rows are scored each, and train once. Texts are scored in one pass, of any length. No documents
give no rows. Only doc_id, text and toxic are read; `score` returns columns of its own, `clean` the columns of docs, whatever their names.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import frugal, unit_hash

#: Bound of the training sample, for each label.
SAMPLE_ROWS = 6_000
#: Bound of the lexicon.
ENTRIES = 20_000
#: A word's beginnings of these lengths are candidates, besides the word itself.
BEGINNINGS = (4, 5, 6, 7)
#: Least number of toxic texts with an entry, least log odds, and these in standard errors.
LEAST_TEXTS, LEAST_ODDS, LEAST_Z = 5, 1.0, 3.5
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Entries that a task counts before it hands them on.
HELD = 150_000

# Letters that look like Latin ones, and digits and signs used in place of letters.
HOMOGLYPHS = dict(zip("аеорсухкмтвніјѕԁɡһԛԝαεορυχκντιΑΕΟΡΥΧΚΝΤΙ", "aeopcyxkmtbhijsdghqwaeopuxkvtiaeopyxknti", strict=False))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """A translation table that works out each character once."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        c = DIGITS.get(c, c)
        c = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKC", c).lower())
        self[point] = out = c if c and all(x.isalnum() or unicodedata.combining(x) for x in c) else " "
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    return (text or "").translate(_FOLD)


def words_of(text: str | None) -> list[str]:
    return fold(text).split()


@dataclass
class Lexicon:
    """entries: " word " or " beginning" and weights; exceptions: phrases of whole words in which nothing counts."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    power: float = 0.5
    slope: float = 1.0
    offset: float = 0.0
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                a.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                a.add_word(f" {' '.join(words_of(phrase))} ", (len(" ".join(words_of(phrase))) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, text: str | None) -> tuple[float, int]:
        """The sum of the weights in a text, and its number of words."""
        words = words_of(text)
        if not (self.entries or self.exceptions) or not words:
            return 0.0, len(words)
        by_start: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton().iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                excepted.append((start, end))
            elif weight > by_start.get(start, -np.inf):
                by_start[start] = weight
        if excepted:
            spans = sorted(excepted)
            starts = [a for a, _ in spans]
            reach = list(accumulate((b for _, b in spans), max))  # the furthest end of the phrases that start so far
            by_start = {s: w for s, w in by_start.items() if not (k := bisect_right(starts, s)) or reach[k - 1] <= s}
        return sum(by_start.values()), len(words)

    def score(self, weight: float, words: int) -> float:
        x = self.slope * weight / (words + 1) ** self.power + self.offset
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _features(words: list[str]) -> set[str]:
    """Whole words and beginnings."""
    kinds = set(words)
    out = {f" {w} " for w in kinds}
    for n in BEGINNINGS:
        out.update(f" {w[:n]}" for w in kinds if len(w) >= n)
    return out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of a partition's texts with the numbers of toxic and other texts that hold them."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            (toxic if label else other).update(_features(words_of(text.as_py())))
            if len(toxic) + len(other) > HELD:
                yield from _counted(toxic, other)
    yield from _counted(toxic, other)


def _counted(toxic: Counter, other: Counter) -> Iterator[pa.RecordBatch]:
    """The counts as rows; the counters are emptied."""
    keys = list(toxic.keys() | other.keys())
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([other[k] for k in part], pa.int64())], names=["entry", "pos", "neg"])
    toxic.clear()
    other.clear()


def _count_pairs(entries: set[str]):
    """Pairs of neighbouring words of which one is among the entries."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        whole = {e.strip() for e in entries if e.endswith(" ")}
        starts = {e.strip() for e in entries if not e.endswith(" ")}
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = words_of(text.as_py())
                hit = [w in whole or any(w[:n] in starts for n in BEGINNINGS) for w in words]
                (toxic if label else other).update({f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y})
                if len(toxic) + len(other) > HELD:
                    yield from _counted(toxic, other)
        yield from _counted(toxic, other)

    return count


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and loss of a logistic curve, by Newton's method with a small penalty."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        g = a.T @ (weight * (y - p)) - 1e-3 * b * [1, 0]
        h = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + 1e-3 * np.diag([1, 1e-3])
        step = np.linalg.solve(h, g)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ b, -40, 40))), 1e-12, 1 - 1e-12)
    return float(b[0]), float(b[1]), float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = (), seed: int = 2) -> Lexicon:
    """A lexicon from docs(doc_id, text) and labels(doc_id, toxic); usable is a condition on doc_id that a training row must meet."""
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = float(max(sizes, default=0))
        return Lexicon({}, exceptions, offset=40.0 if share else -40.0)
    rate = {k: min(1.0, sample_rows / n) for k, n in sizes.items()}
    picked = marked.where(unit_hash(F.col("doc_id"), seed=seed) < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull())  # at most about 2 sample_rows keys
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic")).persist()
    try:
        n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = n.get(1, 0), n.get(0, 0)
        odds = lambda pos, neg: F.log((pos + 0.5) / (n1 + 1.0)) - F.log((neg + 0.5) / (n0 + 1.0))
        z = lambda pos, neg: odds(pos, neg) / F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        pos, neg = F.col("pos"), F.col("neg")
        counted = sample.mapInArrow(frugal(_count), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        good = counted.where((pos >= LEAST_TEXTS) & (odds(pos, neg) >= LEAST_ODDS) & (z(pos, neg) >= LEAST_Z)).select("entry", odds(pos, neg).alias("weight"), z(pos, neg).alias("z"), neg)
        best = good.orderBy(F.desc("z"), "entry").limit(ENTRIES).collect()
        entries = {r["entry"]: r["weight"] for r in best}
        found = tuple(exceptions)
        mixed = {r["entry"] for r in best if r["neg"] >= LEAST_TEXTS}  # others need no exceptions
        if mixed:
            pairs = sample.mapInArrow(frugal(_count_pairs(mixed)), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            calm = pairs.where((neg >= LEAST_TEXTS) & (z(pos, neg) <= -LEAST_Z)).orderBy(F.asc(z(pos, neg)), "entry").limit(ENTRIES)
            found += tuple(r["entry"] for r in calm.select("entry").collect())
        lexicon = Lexicon(entries, found)

        def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = [lexicon.weigh(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in w], pa.float64()), pa.array([x for _, x in w], pa.int64()), batch.column("toxic").cast(pa.int32())], names=["weight", "words", "toxic"])

        rows = sample.mapInArrow(frugal(weigh), "weight double, words long, toxic int").toArrow()
    finally:
        sample.unpersist()
    weight, words, y = (rows.column(c).to_numpy().astype(np.float64) for c in ("weight", "words", "toxic"))
    each = np.where(y == 1, 1 / rate[1], 1 / rate[0])
    fits = [(*_fit(weight / (words + 1) ** p, y, each), p) for p in POWERS]
    lexicon.slope, lexicon.offset, _, lexicon.power = min(fits, key=lambda f: f[2])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score and the number of words of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most ENTRIES entries and as many phrases

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            found = [lex.weigh(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([lex.score(*f) for f in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "score", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(of), "doc_id long, score double, n_words long")


def clean(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5) -> DataFrame:
    """The rows of docs, of any columns with text among them, that score below the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [shared.value.score(*shared.value.weigh(t.as_py())) < limit for t in batch.column("text")]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(frugal(keep), docs.schema)
