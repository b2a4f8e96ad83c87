from __future__ import annotations

import hashlib

from pricewren.llm import fingerprints, queries
from tests.llm.making import ODD, SF_DIR, crowded, documents, empty, prose


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + other[:q]
        d = [fingerprints.digest(x.encode()) for x in (t, edited, other)]
        near = [float(fingerprints.likeness(d[0][None], x[None])[0]) for x in d[1:]]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.to_text(d[0]), fingerprints.to_text(d[1]), *near))
    return out


def key(r):
    return tuple((x is not None, x or 0) if k < 2 else x for k, x in enumerate(r))


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    found = [tuple(r) for r in queries.op1_fingerprints(spark, SF_DIR).collect()]
    assert sorted(found, key=key) == sorted(brute(rows), key=key)


def test_odd_rows(spark):
    found = [tuple(r) for r in fingerprints.neighbour_digests(crowded(documents(spark, ODD))).collect()]
    assert sorted(found, key=key) == sorted(brute(ODD), key=key)
    assert fingerprints.neighbour_digests(empty(spark)).count() == 0
    (one,) = fingerprints.neighbour_digests(documents(spark, [(1, "abcdefgh")])).collect()
    assert one["near_next"] == 1.0


def test_likeness():
    texts = prose(40)
    d = [fingerprints.digest(t.encode()) for t in texts]
    assert all(fingerprints.likeness(x[None], x[None])[0] == 1.0 for x in d)
    near = [fingerprints.likeness(x[None], fingerprints.digest((t + " end").encode())[None])[0] for x, t in zip(d, texts)]
    far = [fingerprints.likeness(x[None], y[None])[0] for x, y in zip(d, d[1:])]
    assert sum(near) / len(near) > 0.9 and max(far) < min(near)  # a quartile that moves by one shifts many buckets at once
    assert all((fingerprints.from_text(fingerprints.to_text(x)) == x).all() for x in d)
