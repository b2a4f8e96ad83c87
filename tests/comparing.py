"""Rows of a Spark query and of its SQL in DuckDB, brought to one form."""

from __future__ import annotations

import datetime
import math
import pathlib
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if pathlib.Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime) and x.tzinfo:
        return x.astimezone(datetime.UTC).replace(tzinfo=None)
    return x


def differences(df, con, sql: str) -> list[str]:
    names = sorted(df.columns)
    found = con.execute(sql)
    theirs = [d[0] for d in found.description]
    if sorted(theirs) != names:
        return [f"columns {names} and {sorted(theirs)}"]
    kinds = {d[0]: str(d[1]) for d in found.description}
    out = [f"type of {n}: {k} and {kinds[n]}" for n, k in df.dtypes if KINDS.get(k, kinds[n]) != kinds[n] and not k.startswith("array")]
    places = [theirs.index(n) for n in names]
    right = Counter(tuple(plain(r[i]) for i in places) for r in found.fetchall())
    left = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    if left != right:
        a, b = left - right, right - left
        out.append(f"rows {sum(left.values())} and {sum(right.values())}; only left {sum(a.values())}: {list(a)[:2]}; only right {sum(b.values())}: {list(b)[:2]}; {names}")
    return out
