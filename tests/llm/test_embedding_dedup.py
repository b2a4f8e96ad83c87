from __future__ import annotations

import math

import numpy as np
import pytest

from pricewren.llm import embedding_dedup, queries
from tests.llm.making import SF_DIR


def brute(rows, cosine):
    """n_links and component of each vec_id by all pairs, and the number of links."""
    ok = [(i, v) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n in {len(v) for _, v in ok}:
        ids = [i for i, v in ok if len(v) == n]
        x = np.array([v for _, v in ok if len(v) == n], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        for i, j in zip(a.tolist(), b.tolist()):
            links[ids[i]] += 1
            links[ids[j]] += 1
            p, q = find(ids[i]), find(ids[j])
            root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i, _ in rows}


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    truth = brute(rows, 0.9)
    found = {r["vec_id"]: r for r in queries.op7_embedding_dedup(spark, SF_DIR).collect()}
    assert found.keys() == truth.keys()
    assert all(found[i]["n_links"] <= n for i, (n, _) in truth.items())
    assert sum(r["n_links"] for r in found.values()) >= 0.95 * sum(n for n, _ in truth.values())
    assert sum(found[i]["component_id"] == c for i, (_, c) in truth.items()) >= 0.97 * len(truth)
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in found.values())


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(24).tolist()
    other = rng.standard_normal(24).tolist()
    rows = [(i, base) for i in range(10)] + [(20, [2 * x for x in base]), (21, other), (22, None), (23, []), (24, [0.0] * 24), (25, [None, *base[1:]]), (26, [float("nan"), *base[1:]]), (27, base[:12]), (28, [math.inf] * 24), (None, base)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, cid string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(found[i] == (10, 0, i == 0) for i in [*range(10), 20])
    assert all(found[i] == (0, i, True) for i in range(21, 29)) and found[None] == (0, None, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def planted(n, groups, length, seed):
    """Vectors at random, and groups of vectors at cosines around the threshold from a middle."""
    rng = np.random.default_rng(seed)
    out = list(rng.standard_normal((n, length)))
    for _ in range(groups):
        middle = rng.standard_normal(length)
        middle /= np.linalg.norm(middle)
        for _ in range(int(rng.integers(2, 12))):
            other = rng.standard_normal(length)
            other -= (other @ middle) * middle
            c = rng.uniform(0.9, 0.99)
            out.append(c * middle + (1 - c * c) ** 0.5 * other / np.linalg.norm(other))
    return [(i, v.tolist()) for i, v in enumerate(out)]


def test_recall_with_several_hashes_in_a_key(spark):
    rows = planted(500, 250, 48, 3) + [(100_000 + i, v) for i, v in planted(50, 30, 7, 4)]
    truth = brute(rows, 0.9)
    links = sum(n for n, _ in truth.values())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for hashes in (1, 2, 3):
        assert hashes == 1 or embedding_dedup.hashing_for(10, 64, 0.9, hashes=hashes).tables > embedding_dedup.hashing_for(10, 64, 0.9, hashes=hashes - 1).tables
        found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, hashes=hashes).collect()}
        assert all(found[i]["n_links"] <= n for i, (n, _) in truth.items())
        assert sum(r["n_links"] for r in found.values()) >= 0.97 * links and links > 1000


def test_groups_of_several_blocks(spark, monkeypatch):
    """Blocks of few vectors, in buckets as in groups, give the same links; an impossible recall is an error."""
    rows = planted(60, 40, 16, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda found: {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    whole = key(embedding_dedup.near_duplicates(df))
    for name, value in (("BLOCK", 3), ("ASKERS", 4), ("GROUP_BLOCK", 16)):
        monkeypatch.setattr(embedding_dedup, name, value)
    assert key(embedding_dedup.near_duplicates(df)) == whole
    big = spark.createDataFrame([(i, [math.cos(i / 900), math.sin(i / 900)]) for i in range(300)], "vec_id long, embedding array<double>")
    assert key(embedding_dedup.near_duplicates(big, 0.999)) == brute([(r["vec_id"], r["embedding"]) for r in big.collect()], 0.999)
    with pytest.raises(ValueError, match="tables"):
        embedding_dedup.hashing_for(10, 64, 0.1)


def test_rounding_loses_nothing():
    rng = np.random.default_rng(8)
    x, _ = embedding_dedup.unit_vectors(rng.standard_normal((300, 40)).tolist())
    small = embedding_dedup.rounded(x)
    over = embedding_dedup.highest(small, small) - x @ x.T
    assert over.min() >= 0 and over.max() < 0.06
