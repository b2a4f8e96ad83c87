"""Bulk import against a plain loop over the rows, and keyed tables whose batches are cut off and repeated."""

from __future__ import annotations

import random

import pytest

from pricewren.operators import imports
from pricewren.sources import keyed

FILE = "row long, sku string, name string, urls array<string>, brand string, category string, our_price double"


def plain(rows, products, listings, update_existing=True):
    """One row after the other, as if each were saved before the next."""
    products, listings, out = {k: dict(v) for k, v in products.items()}, dict(listings), {}
    for row, sku, name, urls, *values in sorted(rows):
        urls = [u.strip(" ") for u in urls or [] if u and u.strip(" ")]
        bad = [w for w in (None if u.startswith("https://h/") and u != "https://h/" else "home_page" if u == "https://h/" else "not_http" if u.startswith("ftp:") else "invalid" for u in urls) if w]
        if not urls or bad:
            out[row] = ("failed", 0, bad[0] if urls else "no_urls")
            continue
        key = f"sku:{sku}" if sku else f"row:{row}"
        known = key in products
        if known and not update_existing:
            out[row] = ("skipped", 0, None)
            continue
        product = products.setdefault(key, {"sku": sku or None, "brand": None, "category": None, "our_price": None})
        product["name"] = name
        product |= {c: v for c, v in zip(imports.VALUES, values) if v is not None}
        added = 0
        for i, u in enumerate(urls):
            if (key, u) not in listings:
                listings[key, u] = i == 0 and not known
                added += 1
        out[row] = ("updated" if known else "created", added, None)
    return out, products, listings


def made(seed, n=120, start=0):
    r = random.Random(seed)
    url = lambda: r.choice(["https://h/a", " https://h/b ", "https://h/c", "https://h/a?x=1"] * 4 + ["https://h/", "ftp://h/a", "what", "", None])
    return [(start + i, r.choice(["A", "B", "C", "D", "E", "", None]), r.choice(["n1", "n2", "n3"]), r.choice([None, [url()], [url(), url()], [url(), url(), url()]]), r.choice([None, "b1", "b2"]), r.choice([None, "c"]), r.choice([None, 1.0, 2.0])) for i in range(n)]


def tables_of(spark, folder):
    products = {r["key"]: {c: r[c] for c in ("sku", "name", *imports.VALUES)} | {"n": r["competitor_count"]} for r in keyed.read(spark, f"{folder}/products", imports.PRODUCTS).collect()}
    rows = keyed.read(spark, f"{folder}/listings", imports.LISTINGS).collect()
    assert len(rows) == len({(r["key"], r["url"]) for r in rows}) and {r["host"] for r in rows} <= {"h"}
    return products, {(r["key"], r["url"]): r["is_primary"] for r in rows}


def counted(products, listings):
    return {k: v | {"n": sum(1 for key, _ in listings if key == k)} for k, v in products.items()}


@pytest.mark.parametrize("update", [True, False])
def test_against_a_loop(spark, tmp_path, update):
    folder, products, listings = str(tmp_path), {}, {}
    for batch in (1, 2):
        rows = made(batch, start=1000 * batch)
        expected, products, listings = plain(rows, products, listings, update)
        for _ in range(2):
            found = imports.load(spark, folder, spark.createDataFrame(rows, FILE), batch, update)
            assert {r["row"]: (r["status"], r["listings_added"], r["problem"]) for r in found.collect()} == expected
    assert tables_of(spark, folder) == (counted(products, listings), listings)
    told = imports.load(spark, folder, spark.createDataFrame([(1, "A", "n", ["https://h/a", "https://h/zz"], None, None, None), (2, "new", "n", ["https://h/q"], None, None, None)], FILE), 3, update, dry_run=True)
    assert sorted(tuple(r)[2:4] for r in told.collect()) == sorted([("updated", 2) if update else ("skipped", 0), ("created", 1)])
    assert tables_of(spark, folder) == (counted(products, listings), listings)


def test_cut_off_and_repeated(spark, tmp_path, monkeypatch):
    """A write that ends before its ledger, or between the two tables, is as if it had not been once its batch comes again."""
    folder, rows = str(tmp_path), made(5)
    expected, products, listings = plain(rows, {}, {})
    file, put, calls = spark.createDataFrame(rows, FILE), keyed.put, []

    def cut(spark_, path, *args, **kwargs):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("lost")
        return put(spark_, path, *args, **kwargs)

    monkeypatch.setattr(keyed, "put", cut)
    with pytest.raises(OSError):
        imports.load(spark, folder, file, 1)
    assert tables_of(spark, folder)[0] == {} and tables_of(spark, folder)[1] == listings
    monkeypatch.setattr(keyed, "put", put)
    # Files of a write without a ledger.
    file.limit(3).withColumn("bucket", file["row"] * 0).write.partitionBy("bucket").parquet(f"{folder}/products/data/batch=1")
    assert keyed.read(spark, f"{folder}/products", imports.PRODUCTS).count() == 0
    found = imports.load(spark, folder, file, 1)
    assert {r["row"]: (r["status"], r["listings_added"], r["problem"]) for r in found.collect()} == expected
    assert tables_of(spark, folder) == (counted(products, listings), listings)


def test_tables_of_no_rows(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert imports.load(spark, folder, spark.createDataFrame([], FILE), 1).count() == 0
    assert tables_of(spark, folder) == ({}, {})
    assert not keyed.put(spark, f"{folder}/products", keyed.read(spark, f"{folder}/products", imports.PRODUCTS), imports.PRODUCTS, ("key",), 1)
    row = spark.createDataFrame([(None, "s", "n", None, None, 1.0, 0)], imports.PRODUCTS)
    for batch in (2, 3):
        assert keyed.put(spark, f"{folder}/products", row, imports.PRODUCTS, ("key",), batch)
    assert keyed.read(spark, f"{folder}/products", imports.PRODUCTS).count() == 1
    for batch, buckets in ((2, 32), (4, 8)):
        if batch == 2:
            assert not keyed.put(spark, f"{folder}/products", row, imports.PRODUCTS, ("key",), batch)
        else:
            with pytest.raises(ValueError):
                keyed.put(spark, f"{folder}/products", row, imports.PRODUCTS, ("key",), batch, buckets)
