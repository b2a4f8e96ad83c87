"""Views of the star schema as the entities of the engine: products, listings, price history, suppliers with terms, orders, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.money import money_round

#: Order of a price series: time, then the keys that make it total.
SERIES_ORDER = ("recorded_at", "competitor_id", "order_id", "line_no", "price")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, competitor_id, price, recorded_at, and order_id and line_no to break ties."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("competitor_id"),
        money_round(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("recorded_at"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("our_price"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest price of each product at each supplier: product_id, competitor_id, price, updated_at."""
    newest = Window.partitionBy("product_id", "competitor_id").orderBy(*[F.desc(c) for c in SERIES_ORDER if c != "competitor_id"])
    rows = price_history(spark, sf_dir).withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    return rows.select("product_id", "competitor_id", "price", F.col("recorded_at").alias("updated_at"))


def supplier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are arithmetic of the supplier's key: discount, tax, shipping and order minimum."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.concat(F.lit("shop"), (k % 40).cast("string"), F.when(k % 3 == 0, ".example.com").when(k % 3 == 1, ".store.example.org").otherwise(".example.net")).alias("host"),
        (k % 20).cast("double").alias("discount_percent"),
        F.when(k % 3 == 0, "inclusive").when(k % 3 == 1, "exclusive").otherwise("unknown").alias("vat_state"),
        F.lit(20.0).alias("vat_rate"),
        F.when(k % 4 == 0, 0.0).otherwise((5 + k % 10).cast("double")).alias("shipping_cost"),
        F.when(k % 2 == 0, (1000 * (1 + k % 5)).cast("double")).alias("free_shipping_over"),
        (k % 3).cast("double").alias("handling_fee"),
        (500 * (k % 4)).cast("double").alias("min_order_value"),
        F.when(k % 5 == 0, "BGN").when(k % 5 == 1, "USD").otherwise("EUR").alias("currency"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase decisions: orders with an optimised total and a saving that are arithmetic of their keys; orders of status F are realised."""
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    optimised = money_round(total * (1 - (k % 10).cast("double") / 100))
    return table(spark, sf_dir, "orders").select(
        k.alias("decision_id"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("currency"),
        total.alias("baseline_total"),
        optimised.alias("optimised_total"),
        money_round(total - optimised).alias("savings"),
        F.when(F.col("o_orderstatus") == "F", "realized").otherwise("potential").alias("savings_kind"),
    )


def order_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id and the sorted array of its suppliers."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"))
    return rows.agg(F.array_sort(F.collect_set("l_suppkey")).alias("supplier_ids"))


#: The same terms for SQL: a common table expression over supplier.
TERMS_SQL = """
terms AS (
  SELECT s_suppkey AS supplier_id, s_name AS supplier_name,
    'shop' || CAST(s_suppkey % 40 AS VARCHAR) || CASE s_suppkey % 3 WHEN 0 THEN '.example.com' WHEN 1 THEN '.store.example.org' ELSE '.example.net' END AS host,
    CAST(s_suppkey % 20 AS DOUBLE) AS discount_percent,
    CASE s_suppkey % 3 WHEN 0 THEN 'inclusive' WHEN 1 THEN 'exclusive' ELSE 'unknown' END AS vat_state,
    CAST(20 AS DOUBLE) AS vat_rate,
    CASE WHEN s_suppkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(5 + s_suppkey % 10 AS DOUBLE) END AS shipping_cost,
    CASE WHEN s_suppkey % 2 = 0 THEN CAST(1000 * (1 + s_suppkey % 5) AS DOUBLE) END AS free_shipping_over,
    CAST(s_suppkey % 3 AS DOUBLE) AS handling_fee,
    CAST(500 * (s_suppkey % 4) AS DOUBLE) AS min_order_value,
    CASE s_suppkey % 5 WHEN 0 THEN 'BGN' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency
  FROM supplier)"""

#: money_round and percentages for SQL, as text around an expression.
EPS = "2.220446049250313e-16"


def sql_money(x: str, digits: int = 2) -> str:
    return f"(CAST(floor(({x} + CAST({EPS} AS DOUBLE)) * CAST({10**digits} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS DOUBLE) / CAST({10**digits} AS DOUBLE))"


def sql_plain(x: str, digits: int = 2) -> str:
    return f"(CAST(floor(({x}) * CAST({10**digits} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS DOUBLE) / CAST({10**digits} AS DOUBLE))"


HISTORY_SQL = f"""
history AS (
  SELECT l_partkey AS product_id, l_suppkey AS competitor_id, {sql_money("l_extendedprice / l_quantity")} AS price,
    l_shipdate AS recorded_at, l_orderkey AS order_id, l_linenumber AS line_no
  FROM lineitem)"""

LISTINGS_SQL = (
    HISTORY_SQL
    + """,
listings AS (
  SELECT product_id, competitor_id, price, recorded_at AS updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY recorded_at DESC, order_id DESC, line_no DESC, price DESC) AS rn FROM history) AS x
  WHERE rn = 1)"""
)

_OPTIMISED = sql_money("o_totalprice * (1 - CAST(o_orderkey % 10 AS DOUBLE) / 100)")
DECISIONS_SQL = f"""
decisions AS (
  SELECT o_orderkey AS decision_id, o_custkey AS owner_id, o_orderdate AS created_at, o_orderstatus AS status, o_orderpriority AS currency,
    o_totalprice AS baseline_total, {_OPTIMISED} AS optimised_total, {sql_money(f"o_totalprice - {_OPTIMISED}")} AS savings,
    CASE WHEN o_orderstatus = 'F' THEN 'realized' ELSE 'potential' END AS savings_kind
  FROM orders)"""

SUPPLIERS_SQL = """
order_suppliers AS (SELECT l_orderkey AS order_id, list_sort(list(DISTINCT l_suppkey)) AS supplier_ids FROM lineitem GROUP BY l_orderkey)"""
