"""Near duplicates among embeddings by cross-polytope hashing.

Vectors are rotated at random (three rounds of random signs and a fast Hadamard transform); the hash is the coordinate of the largest
absolute value with its sign. A table's key joins several such hashes; each vector lies in its own bucket of a table and asks, besides, the
few buckets that its next largest coordinates point to. Every vector is indexed and asked.

The number of hashes in a key grows with the number of vectors, so that buckets of unrelated vectors stay small; the number of tables is
then set by simulation so that a pair just at the threshold meets with a probability of at least RECALL. Where MOST_TABLES tables don't reach
that, a hash less is taken (larger buckets, the same recall), and if one hash is too much, an error tells so. Vectors of each size (length up
to the next power of two) have hashes and tables of their own.

What goes to the buckets are vectors rounded to 8 bits a coordinate, with what that can change in a cosine at most: a pair is a candidate if
its cosine may reach the threshold, so rounding loses nothing. A bucket's vectors are cut into blocks, and what leaves a task is a spanning forest of
the candidates, never the pairs. Each group of candidates is then verified as a whole, by cosines in double precision of all its vectors, in
pairs of blocks; each vector in full goes to its own group alone. Links are what passes, whether or not the pair met in a bucket. Equal vectors are one
vector with a multiplicity.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with a null id
(their component is null, and they are kept); vectors of different lengths never link; a cosine just at the threshold links; repeated rows
count each; no rows give no rows. Only vec_id and embedding are read, so other columns, of whatever name, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import Written, frugal
from pricewren.llm.components import components
from pricewren.llm.shingles import mix

#: Least probability that a pair at the threshold meets, and bounds of the tables.
RECALL, MOST_TABLES = 0.985, 40
#: Buckets asked besides a vector's own.
PROBES = 3
#: Vectors of a bucket that are compared as one block, and askers at a time.
BLOCK, ASKERS = 512, 1024
#: Coordinates of a block of a group that is verified.
GROUP_BLOCK = 1 << 18
#: Mean number of unrelated vectors in a bucket that is aimed at, and most hashes in a key.
CROWD, MOST_HASHES = 64, 5

Batches = Iterable[pa.RecordBatch]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of the rows, of a length that is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


@dataclass(frozen=True)
class Hashing:
    size: int  # of the padded vectors
    hashes: int
    tables: int
    probes: int = PROBES
    seed: int = 7

    def codes(self, x: np.ndarray) -> np.ndarray:
        """By vector, table, and own bucket or probe: the key inside the table. x holds unit vectors in rows."""
        n, d = x.shape
        padded = np.zeros((n, self.size))
        padded[:, :d] = x
        signs = np.random.default_rng(self.seed).integers(0, 2, (MOST_TABLES, MOST_HASHES, 3, self.size)) * 2.0 - 1
        out = np.empty((n, self.tables, 1 + self.probes), dtype=np.int64)
        ranks = min(3, self.size)
        choices = np.array(sorted(product(range(ranks), repeat=self.hashes), key=lambda c: (sum(c), c)))
        for t in range(self.tables):
            places, losses = [], []
            for j in range(self.hashes):
                y = padded
                for r in range(3):
                    y = hadamard(y * signs[t, j, r]) / self.size**0.5
                a = np.abs(y)
                top = np.argpartition(-a, ranks - 1, axis=1)[:, :ranks]
                value = np.take_along_axis(a, top, axis=1)
                order = np.argsort(-value, axis=1, kind="stable")
                top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
                places.append(2 * top + (np.take_along_axis(y, top, axis=1) < 0))
                losses.append((value[:, :1] - value) ** 2)
            loss = sum(losses[j][:, choices[:, j]] for j in range(self.hashes))
            best = choices[np.argsort(loss, axis=1, kind="stable")[:, : 1 + self.probes]]
            key = np.zeros(best.shape[:2], dtype=np.int64)
            for j in range(self.hashes):
                key = key * (2 * self.size) + np.take_along_axis(places[j], best[:, :, j], axis=1)
            out[:, t, : key.shape[1]] = key
            out[:, t, key.shape[1] :] = key[:, :1]
        return out


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By pair and table: whether one's bucket is among those that the other asks (its own included)."""
    return (b[:, :, :1] == a).any(axis=2) | (a[:, :, :1] == b).any(axis=2)


def hashing_for(vectors: int, size: int, cosine: float, probes: int = PROBES, seed: int = 7, hashes: int | None = None) -> Hashing:
    """Hashes in a key by the number of vectors, then as many tables as the recall takes, by a simulation of pairs at the threshold."""
    if hashes is None:
        hashes = 1
        while hashes < MOST_HASHES and vectors / (2 * size) ** hashes > CROWD:
            hashes += 1
    rng = np.random.default_rng(seed + 1)
    x, y = rng.standard_normal((2, 1000, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + (1 - cosine**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    for n in range(hashes, 0, -1):
        trial = Hashing(size, n, MOST_TABLES, probes, seed)
        met = np.logical_or.accumulate(meets(trial.codes(x), trial.codes(y)), axis=1).mean(axis=0)
        enough = np.flatnonzero(met >= RECALL)
        if len(enough):
            return Hashing(size, n, int(enough[0]) + 1, probes, seed)
    raise ValueError(f"{MOST_TABLES} tables don't find pairs of cosine {cosine} in {size} dimensions with a probability of {RECALL}")


def padded(length: int) -> int:
    return max(2, 1 << (length - 1).bit_length())


def unit_vectors(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of lists of one length, and which of them are usable."""
    x = np.array(lists, dtype=np.float64)
    with np.errstate(all="ignore"):
        largest = np.abs(x).max(axis=1, keepdims=True)
        x = x / largest
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x, np.isfinite(x).all(axis=1)


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in 8 bits a coordinate, and by row what a step is worth and the sum of absolute values."""
    step = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    return np.round(x / step[:, None]).astype(np.int8), np.stack([step, np.abs(x).sum(axis=1)], axis=1).astype(np.float32)


def highest(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What the cosines of two sets of rounded vectors are at most: a coordinate is off by half a step at most."""
    (q, f), (r, g) = a, b
    s, t = f[:, :1].astype(np.float64), g[:, 0][None].astype(np.float64)
    return (q.astype(np.float32) @ r.astype(np.float32).T) * (s * t) * (1 + 1e-6) + (s * g[:, 1] + f[:, 1:] * t) / 2 * (1 + 1e-6) + s * t * q.shape[1] / 4 + 1e-6


def _coded(hashings: dict[int, Hashing]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A row for each vector, table and bucket, its own (probe false) or one that it asks, and one (key null) with the rounded vector."""
    names = ["key", "cid", "probe", "small", "facts"]

    def coded(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                vectors, cids = part.column("embedding").to_pylist(), part.column("cid").to_numpy()
                lengths = np.array([len(v) for v in vectors])
                for n in np.unique(lengths):
                    rows = np.flatnonzero(lengths == n)
                    x, ok = unit_vectors([vectors[i] for i in rows])
                    rows, x = rows[ok], x[ok]
                    if not len(rows):
                        continue
                    h, cid = hashings[padded(int(n))], cids[rows]
                    codes = h.codes(x)
                    tables = np.arange(h.tables, dtype=np.uint64)[None, :, None] << np.uint64(48) | np.uint64(int(n) << 54 & (1 << 64) - 1)
                    keys = mix(codes.astype(np.uint64) ^ mix(tables)).view(np.int64)
                    use, probe = np.ones(keys.shape, dtype=bool), np.zeros(keys.shape, dtype=bool)
                    use[:, :, 1:], probe[:, :, 1:] = keys[:, :, 1:] != keys[:, :, :1], True
                    of = np.broadcast_to(cid[:, None, None], keys.shape)[use]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[use]), pa.array(of), pa.array(probe[use]), pa.nulls(len(of), pa.binary()), pa.nulls(len(of), pa.binary())], names=names)
                    q, facts = rounded(x)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(cid), pa.int64()), pa.array(cid), pa.nulls(len(cid), pa.bool_()), pa.array([v.tobytes() for v in q], pa.binary()), pa.array([f.tobytes() for f in facts], pa.binary())], names=names)

    return coded


def _met(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Rows come by key, probe and cid. Drops those of buckets where nothing can meet, and numbers the blocks of a bucket's own vectors."""
    held: list[np.ndarray] | None = None
    rank_of, rank = None, 0

    def keep(key, cid, probe, use):
        nonlocal rank_of, rank
        key, cid, probe = key[use], cid[use], probe[use]
        firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.concatenate([firsts, [len(key)]]))
        ranks = np.arange(len(key)) - np.repeat(firsts, length)
        if rank_of == key[0]:
            ranks[: length[0]] += rank
        rank_of, rank = int(key[-1]), int(ranks[-1]) + 1
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cid), pa.array(np.where(probe, -1, ranks // BLOCK).astype(np.int32))], names=["key", "cid", "block"])

    for batch in batches:
        key, cid = (batch.column(c).to_numpy() for c in ("key", "cid"))
        probe = batch.column("probe").to_numpy(zero_copy_only=False)
        owned = np.zeros(len(key), dtype=bool)  # whether the row's bucket holds a vector of its own, as far as seen
        if held is not None:
            key, cid, probe = (np.concatenate([a, b]) for a, b in zip(held[:3], (key, cid, probe), strict=True))
            owned = np.concatenate([held[3], owned])
        same = key[1:] == key[:-1]
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(key)]])))
        has = ~probe[starts] | owned[starts]
        near = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | owned
        use = near & has[of]
        if use[:-1].any():
            yield keep(key[:-1], cid[:-1], probe[:-1], use[:-1])
        held = [key[-1:], cid[-1:], probe[-1:], np.array([bool(has[of[-1]]) and bool(len(key) > 1 and same[-1] or owned[-1])])]
    if held is not None and held[3][0]:
        yield keep(*held[:3], np.array([True]))


def _joined(near: np.ndarray, own: np.ndarray, ask: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which askers (rows) and own vectors (columns) are linked where near is true."""
    left = near.any(axis=1)
    while left.any():
        x = int(left.argmax())
        left[x] = False
        root, reach, front = int(ask[x]), np.zeros(near.shape[1], dtype=bool), np.array([x])
        while len(front):
            new = near[front].any(axis=0) & ~reach
            reach |= new
            front = np.flatnonzero(near[:, new].any(axis=1) & left)
            left[front] = False
            yield from ((max(root, k), min(root, k)) for k in ask[front].tolist() if k != root)
        yield from ((max(root, k), min(root, k)) for k in own[reach].tolist() if k != root)


def _candidates(cosine: float) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Rows come by key, block, and role (a block's own vectors first, then what asks it). Edges of a spanning forest of the candidates."""

    def candidates(batches: Batches) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        state: dict = {"of": None}

        def compare(own: dict, ask: dict) -> None:
            near = highest((ask["q"], ask["f"]), (own["q"], own["f"])) >= cosine
            near &= ask["cid"][:, None] != own["cid"][None, :]
            if near.any():
                edges.update(_joined(near, own["cid"], ask["cid"]))

        def emit() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], names=["a", "b"])
            edges.clear()

        for batch in batches:
            key, block, cid, role = (batch.column(c).to_numpy() for c in ("key", "block", "cid", "role"))
            small, facts = batch.column("small").to_pylist(), np.frombuffer(b"".join(batch.column("facts").to_pylist()), dtype=np.float32).reshape(-1, 2)
            change = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            bounds = [0, *change.tolist(), len(key)]
            for s, e in zip(bounds, bounds[1:]):
                part = {"cid": cid[s:e], "f": facts[s:e], "q": np.frombuffer(b"".join(small[s:e]), dtype=np.int8).reshape(e - s, -1)}
                name = (int(key[s]), int(block[s]))
                if state["of"] != name:
                    state = {"of": name, "own": None}
                n = int((role[s:e] == 0).sum())
                fresh, asks = ({k: v[at] for k, v in part.items()} for at in (slice(0, n), slice(n, None)))
                if n:  # a block's own vectors may come in two batches
                    state["own"] = fresh if state["own"] is None else {k: np.concatenate([state["own"][k], fresh[k]]) for k in fresh}
                    compare(state["own"], fresh)
                if state["own"] is not None:
                    for x in range(0, len(asks["cid"]), ASKERS):
                        compare(state["own"], {k: v[x : x + ASKERS] for k, v in asks.items()})
                if len(edges) > 200_000:
                    yield from emit()
        yield from emit()

    return candidates


def _verified(cosine: float) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Rows come by grp, first, second and role: the vectors of a group's block, then (role 1) those of a later block that it is compared with. Sums
    of links by vector, and edges of a spanning forest."""

    def verified(batches: Batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        state: dict = {"of": None}

        def compare(own: dict, ask: dict, inside: bool) -> None:
            """inside: own are those before ask and ask itself, each pair once."""
            for x in range(0, len(ask["cid"]), ASKERS):
                part = {k: v[x : x + ASKERS] for k, v in ask.items()}
                for y in range(0, len(own["cid"]), ASKERS):
                    other = {k: v[y : y + ASKERS] for k, v in own.items()}
                    near = part["x"] @ other["x"].T >= cosine
                    near &= part["cid"][:, None] > other["cid"][None, :] if inside else part["cid"][:, None] != other["cid"][None, :]
                    if not near.any():
                        continue
                    for cids, links in ((part["cid"], near @ other["m"]), (other["cid"], part["m"] @ near)):
                        for i in np.flatnonzero(links).tolist():
                            c = int(cids[i])
                            sums[c] = sums.get(c, 0) + int(links[i])
                    edges.update(_joined(near, other["cid"], part["cid"]))

        def emit() -> Iterator[pa.RecordBatch]:
            a, b = list(sums) + [x for x, _ in edges], [None] * len(sums) + [y for _, y in edges]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(sums.values()) + [None] * len(edges), pa.int64())], names=["a", "b", "links"])
            sums.clear()
            edges.clear()

        for batch in batches:
            grp, first, second, cid, m, role = (batch.column(c).to_numpy() for c in ("grp", "first", "second", "cid", "m", "role"))
            vectors = batch.column("embedding").to_pylist()
            lengths = np.array([len(v) for v in vectors])
            change = np.flatnonzero((grp[1:] != grp[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (lengths[1:] != lengths[:-1])) + 1
            bounds = [0, *change.tolist(), len(grp)]
            for s, e in zip(bounds, bounds[1:]):
                part = {"cid": cid[s:e], "m": m[s:e], "x": unit_vectors(vectors[s:e])[0]}
                name = (int(grp[s]), int(first[s]), int(second[s]))
                if state["of"] != name:
                    state = {"of": name, "own": None}
                n = int((role[s:e] == 0).sum())
                fresh, asks = ({k: v[at] for k, v in part.items()} for at in (slice(0, n), slice(n, None)))
                if n:
                    if name[1] == name[2]:
                        if state["own"] is not None:
                            compare(state["own"], fresh, False)
                        compare(fresh, fresh, True)
                    state["own"] = fresh if state["own"] is None else {k: np.concatenate([state["own"][k], fresh[k]]) for k in fresh}
                if state["own"] is not None and len(asks["cid"]):
                    compare(state["own"], asks, False)
                if len(sums) + len(edges) > 200_000:
                    yield from emit()
        yield from emit()

    return verified


def near_duplicates(rows: DataFrame, cosine: float = 0.9, hashes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of rows(vec_id, embedding). hashes: in a key, if not by the number of vectors."""
    spark = rows.sparkSession
    write = Written(spark)
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    usable &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    each = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("usable", F.coalesce(usable, F.lit(False)))
    each = each.withColumn("cid", F.when(F.col("usable"), F.xxhash64(F.lit(1), "embedding"))).withColumn("other", F.xxhash64(F.lit(2), "embedding"))
    classes = each.where("usable").groupBy("cid").agg(F.any_value("embedding").alias("embedding"), F.count("*").alias("m"), F.min("vec_id").alias("rep"), F.min("other").alias("low"), F.max("other").alias("high"))
    classes = write(classes, "vectors")
    size = F.greatest(F.lit(1), F.ceil(F.log2(F.size("embedding"))).cast("int"))
    facts = classes.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("low") != F.col("high")).alias("clashes")).collect()  # at most 31 rows
    if any(r["clashes"] for r in facts):
        raise ArithmeticError("two different vectors have the same 64-bit name")
    ids = each.select("vec_id", "cid")
    if not facts:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    hashings = {1 << r["size"]: hashing_for(r["n"], 1 << r["size"], cosine, hashes=hashes) for r in facts}
    coded = write(classes.select("cid", "embedding").mapInArrow(frugal(_coded(hashings)), "key long, cid long, probe boolean, small binary, facts binary"), "coded")
    asked = coded.where("key is not null").select("key", "cid", "probe").repartition("key").sortWithinPartitions("key", "probe", "cid")
    met = write(asked.mapInArrow(frugal(_met), "key long, cid long, block int"), "met")
    # Buckets of several blocks: every vector also asks the blocks before its own, every prober (block -1) all of them.
    several = met.where("block > 0").groupBy("key").agg(F.max("block").alias("last"))
    blocks = F.when(F.col("block") < 0, F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).otherwise(F.sequence(F.lit(0), F.col("block")))
    placed = met.join(several, "key", "left").select("key", "cid", F.col("block").alias("own"), F.explode(blocks).alias("block"))
    roles = placed.select("key", "block", "cid", F.when(F.col("own") == F.col("block"), 0).otherwise(1).alias("role"))
    small = coded.where("key is null").select("cid", "small", "facts")
    dealt = roles.join(small, "cid").repartition("key", "block").sortWithinPartitions("key", "block", "role", "cid")
    edges = write(dealt.mapInArrow(frugal(_candidates(cosine)), "a long, b long"), "candidates")
    write.drop(coded, met)

    grouped = components(edges).select(F.col("node").alias("cid"), F.col("component").alias("grp"))
    grouped = write(grouped.unionByName(grouped.select(F.col("grp").alias("cid"), "grp").distinct()), "groups")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("members"))
    members = grouped.join(sizes, "grp").join(classes.select("cid", "m", "embedding"), "cid")
    per = F.greatest(F.lit(64), F.floor(F.lit(GROUP_BLOCK) / F.size("embedding")))
    parts = F.ceil(F.col("members") / per).cast("int")
    at = F.pmod(F.xxhash64("cid"), parts).cast("int")
    # A block with itself, with the later ones (role 0) and with the earlier ones (role 1).
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.least(i, F.col("at")).alias("first"), F.greatest(i, F.col("at")).alias("second"), F.when(i < F.col("at"), 1).otherwise(0).alias("role")))
    dealt = members.withColumn("at", at).select("grp", "cid", "m", "embedding", F.explode(pairs).alias("p")).select("grp", "p.*", "cid", "m", "embedding")
    dealt = dealt.repartition("grp", "first", "second").sortWithinPartitions("grp", "first", "second", "role", "cid")
    found = write(dealt.mapInArrow(frugal(_verified(cosine)), "a long, b long, links long"), "links")
    write.drop(edges, grouped)
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    reached = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    of = classes.select("cid", "m", "rep").join(reached, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = of.join(smallest, "component").join(links, "cid", "left").select("cid", "component_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = ids.join(named, "cid", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
