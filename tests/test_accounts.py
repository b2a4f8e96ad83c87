"""Word rules, seals, locales, quotas and the SQL surface on small cases."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from pricewren.functions import accounts, text
from pricewren.operators import catalog, offers, reports
from pricewren.sources import surface


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_spellings_of_sizes(spark):
    cases = {"cable 4x16": "cable 4х16", "4 Х 16 мм": "4 x 16 мм", "2x2x2": "2х2х2", "pipe 3.75": "pipe 3,75", "1,5x2.5": "1.5х2,5", "x-ray 5": None, "a.b,c": None, "": None}
    assert {k: one(spark, k, text.respelled) for k in cases} == cases and one(spark, None, text.respelled) is None


def test_spellings_of_codes(spark):
    cases = {" AB-12/3 ": ["AB-12/3", "AB 12 3", "AB123"], "AB12": ["AB12"], "A 1": ["A 1", "A1"], "": [], None: []}
    assert {k: one(spark, k, text.identifier_spellings) for k in cases} == cases


def test_names_of_addresses(spark):
    cases = {"https://a.example/p/red_steel--ring/?q=1": "red steel ring", "https://a.example/": "https://a.example/", "https://a.example/%zz": "https://a.example/%zz", "no address": "no address", None: None}
    assert {k: one(spark, k, text.name_from_url) for k in cases} == cases


def test_stems(spark):
    cases = {"batteries": "battery", "boxes": "box", "rings": "ring", "glass": "glass", "gas": "gas", "лампи": "ламп", "кабелите": "кабелит", "столове": "стол", "тръба": "тръб", "": ""}
    assert {k: one(spark, k, text.stem) for k in cases} == cases


def test_locales(spark):
    cases = {"shop.bg": "bg", "www.Shop.RO": "ro", "el.shop.com": "el", "a.gr.shop.eu": "el", "shop.gr": "el", "bgshop.com": "en", "bg": "en", "shop.com": "en", None: None}
    assert {k: one(spark, k, accounts.locale_of) for k in cases} == cases


def test_digest_is_the_library_s(spark):
    for key in (b"k", b"x" * 64, b"long" * 40):
        for message in ("", "draft", "чернова 1,5"):
            assert one(spark, message, lambda x, key=key: accounts.hmac_sha256(x, key)) == hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def test_json_in_one_form(spark):
    a = spark.sql("SELECT named_struct('b', 1, 'a', array(named_struct('z', 'x', 'c', map('k2', 2, 'k1', 1)))) AS v, named_struct('only', CAST(NULL AS STRING)) AS n")
    row = a.select(accounts.canonical_json(F.col("v"), a.schema["v"].dataType).alias("v"), accounts.canonical_json(F.col("n"), a.schema["n"].dataType).alias("n")).first()
    assert row["v"] == json.dumps({"a": [{"c": {"k1": 1, "k2": 2}, "z": "x"}], "b": 1}, separators=(",", ":")) and row["n"] == '{"only":null}'


def test_seals_open_for_an_hour(spark):
    at = datetime.datetime(2024, 5, 1, 12)
    rows = spark.createDataFrame([(m,) for m in (-1, 0, 60, 61)], "m int").select("m", F.lit(at).cast("timestamp_ntz").alias("issued"))
    seal = accounts.sealed(F.lit("p"), F.col("issued"), b"k")
    now = F.col("issued") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m"))
    assert [r[0] for r in rows.orderBy("m").select(accounts.opens(F.lit("p"), F.col("issued"), seal, now, b"k")).collect()] == [False, True, True, False]
    assert not rows.select(accounts.opens(F.lit("q"), F.col("issued"), seal, F.col("issued"), b"k").alias("o")).where("o").count()
    assert not rows.select(accounts.opens(F.lit("p"), F.col("issued"), F.lit(None), F.col("issued"), b"k").alias("o")).where("o is null or o").count()


def test_quota_renews(spark):
    at = datetime.datetime(2024, 5, 1)
    rows = spark.createDataFrame([(1, at), (2, at - datetime.timedelta(days=30)), (3, at - datetime.timedelta(days=30, seconds=1)), (4, None)], "k int, started timestamp_ntz")
    used = rows.select("k", accounts.used_in_period(F.lit(7), F.col("started"), F.lit(at).cast("timestamp_ntz")).alias("u"))
    assert {r["k"]: r["u"] for r in used.collect()} == {1: 7, 2: 7, 3: 0, 4: 0}
    assert one(spark, "pro", lambda x: accounts.limit_of(x, accounts.PLAN_PRODUCTS)) == 500 and one(spark, "other", lambda x: accounts.limit_of(x, accounts.PLAN_PRODUCTS)) is None


def test_worst_state_wins(spark):
    rows = [(1, "h", "ok", "a", 1), (2, "h", None, "b", 1), (3, "h", "empty", "c", 2), (4, "h", "empty", "d", 3), (5, "g", None, "e", 1), (6, "g", "ok", "f", None)]
    out = reports.worst_by_host(spark.createDataFrame(rows, "shop_id int, host string, status string, detail string, owner_id int"))
    assert {tuple(r) for r in out.collect()} == {("h", "empty", "c", 2, 3), ("g", None, "e", 1, 1)}


def test_newest_filled(spark):
    rows = [("a", 1, "[1,2]"), ("a", 2, "[]"), ("a", 3, None), ("b", 1, "[]"), ("c", 1, "no json"), ("d", 5, "[0]"), ("d", 4, "[1,2,3]")]
    out = reports.newest_filled(spark.createDataFrame(rows, "k string, at int, j string"), "k", "j", ["at"])
    assert {(r["k"], r["at"], r["n_elements"]) for r in out.collect()} == {("a", 1, 2), ("d", 5, 1)}


def test_search_is_literal(spark):
    rows = spark.createDataFrame([(1, "Red 10%", {"colour": "Blue"}), (2, "red 100", None), (3, None, {"x": "10% off"})], "k int, name string, m map<string,string>")
    assert sorted(r["k"] for r in catalog.found(rows, "10%", ("name",), "m").collect()) == [1, 3]
    assert [r["k"] for r in catalog.found(rows, "BLUE", ("name",), "m").collect()] == [1]


def test_orders_are_total(spark):
    rows = spark.createDataFrame([(1, 1, 0.95, None), (1, 2, 0.92, 5.0), (1, 3, 0.5, 1.0), (1, 4, None, 0.5), (1, 5, 0.91, 5.0)], "product_id int, competitor_id int, confidence double, price double")
    assert [r["competitor_id"] for r in offers.by_confidence(rows, "product_id").orderBy("place").collect()] == [2, 5, 1, 3, 4]


def test_groups_of_relations(spark):
    cases = [("same_product", 0.9, "strong"), ("same_product", 0.8, "possible"), ("compatible", 0.9, "possible"), ("same_family", 0.9, "similar"), ("unrelated", 1.0, "excluded"), (None, 1.0, None)]
    rows = spark.createDataFrame(cases, "r string, c double, want string").withColumn("got", offers.relation_group(F.col("r"), F.col("c")))
    assert all(r["got"] == r["want"] for r in rows.collect())


def test_sql_functions(spark):
    surface.register(spark)
    row = spark.sql("SELECT money_round(1.005D) AS m, change_percent(0D, 5D) AS z, change_percent(80D, 100D) AS c, net_price(120D, 'inclusive', 20D) AS n, host_of('https://www.A.example:8080/x') AS h, canonical_identifier('АВ-12 x') AS i, confidence_band(0.9D) AS b").first()
    assert tuple(row) == (1.01, None, 25.0, 100.0, "a.example", "ab12x", "high")
    assert [(r[0], r[1]) for r in spark.sql("SELECT * FROM request_rows('5 bolts; ;\n nuts ') ORDER BY line").collect()] == [(0, "5 bolts"), (1, "nuts")]


def test_arguments_are_values(spark):
    got = surface.query(spark, "/root/testdata/sf0.001", "SELECT count(*) AS n FROM products WHERE name = :name", name="' OR true --")
    assert got.first()["n"] == 0
