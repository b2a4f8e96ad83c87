"""Queries over the catalogue."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions.money import money_round
from pricewren.operators import catalog, imports, market
from pricewren.shared import shared_root
from pricewren.sources import keyed, tables
from pricewren.sources.tables import LISTINGS_SQL, sql_money


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with the figures kept with each of them, and states that are arithmetic of the size."""
    now = market.market_prices(tables.listings(spark, sf_dir)).withColumnsRenamed({"market_price": "current_price", "n_listings": "competitor_count"})
    seen = tables.price_history(spark, sf_dir).groupBy("product_id").agg(F.max("recorded_at").alias("last_checked_at"))
    size = F.col("size")
    rows = tables.products(spark, sf_dir).join(now, "product_id", "left").join(seen, "product_id", "left")
    status = F.when(size % 3 == 0, "success").when(size % 3 == 1, "pending").otherwise("failed")
    return rows.withColumn("is_active", size % 5 != 0).withColumn("scrape_status", status).withColumn("target_price", F.when(size % 4 != 0, F.col("our_price")))


def catalog_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.filtered(products(spark, sf_dir), min_price=905.0, max_price=1200.0, undercut_only=True, is_active=True, scrape_status="failed")
    return catalog.page(rows, "current_price", descending=True, limit=25, offset=5).select("product_id", "name", "brand", "current_price", "target_price")


def catalog_search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filtered(tables.products(spark, sf_dir), search="RED%g", category="PROMO").select("product_id", "name", "brand", "category")


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stats(products(spark, sf_dir))


def catalog_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facets(tables.products(spark, sf_dir), ("brand", "category", "name"))


def _price_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    part = tables.table(spark, sf_dir, "part")
    current = part.where(k % 2 == 0).select(k.cast("string").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.lit("pc").alias("unit"))
    price = F.when(k % 9 != 0, money_round(F.col("p_retailprice") * 1.1))
    incoming = part.where(k % 3 == 0).select(k.cast("string").alias("key"), F.col("p_name").alias("name"), price.alias("price"), F.lit(None).cast("string").alias("unit"))
    return current, incoming


def price_list_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upserted(*_price_lists(spark, sf_dir))


def bulk_import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("S"), (F.col("page_id") % 200).cast("string")).alias("sku"))
    known = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sku"))
    return catalog.import_status(pages, known).select("page_id", "sku", "status")


#: A file to import, made from lines of orders (several of an order may have one number: the least of each column counts): skus of a part that recur, gaps, good and bad addresses. SQL of both engines.
_LEAST = ("l_partkey", "l_suppkey", "l_quantity")
_FILE = """l_orderkey * 8 + l_linenumber AS row, CASE WHEN l_orderkey % 11 <> 0 THEN concat('S', l_partkey) END AS sku, concat('item ', l_partkey, ' ', l_linenumber) AS name,
  CASE WHEN l_linenumber % 3 = 0 THEN concat('B', l_suppkey % 30) END AS brand, CASE WHEN l_suppkey % 4 = 0 THEN concat('C', l_linenumber) END AS category,
  CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_quantity AS DOUBLE) END AS our_price, concat(' https://shop', l_suppkey % 40, '.example.com/p/', l_partkey, ' ') AS u1,
  CASE (l_orderkey + l_linenumber) % 13 WHEN 0 THEN 'ftp://x.example.org/a' WHEN 1 THEN 'HTTP://Shop1.example.com//?q=1' WHEN 2 THEN 'nothing' WHEN 3 THEN ' ' WHEN 4 THEN NULL
    WHEN 5 THEN concat('https://shop', l_suppkey % 40, '.example.com/p/', l_partkey) ELSE concat('http://www.store', l_linenumber, '.example.org/i/', l_partkey % 50) END AS u2, (l_orderkey + l_suppkey) % 97 = 0 AS bare"""
_HELD = "concat('S', p_partkey) AS sku, concat('old ', p_name) AS name, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS category, p_retailprice AS our_price"


def _import(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A file, and the products (a third of the parts) and listings that are there before it."""
    lines = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in _LEAST])
    file = lines.selectExpr(*_split(_FILE), "l_orderkey % 2 AS half").withColumn("urls", F.when(~F.col("bare"), F.array("u1", "u2"))).drop("u1", "u2", "bare")
    held = tables.table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    products = held.selectExpr("concat('sku:S', p_partkey) AS key", *_split(_HELD), "1L AS competitor_count")
    listings = held.selectExpr("concat('sku:S', p_partkey) AS key", "concat('https://shop', p_partkey % 40, '.example.com/p/', p_partkey) AS url", "concat('shop', p_partkey % 40, '.example.com') AS host", "true AS is_primary")
    return file, products, listings


def _split(columns: str) -> list[str]:
    """The expressions of a select list, each of which ends in its name."""
    return [c.strip() for c in re.findall(r"(.+?\sAS\s\w+)\s*(?:,|$)", columns, re.DOTALL)]


def bulk_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each row of a file."""
    return imports.outcomes(*_import(spark, sf_dir)).select("row", "key", "status", "listings_added", "problem")


def bulk_import_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.tally(imports.outcomes(*_import(spark, sf_dir), update_existing=False, dry_run=True))


def bulk_import_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products after the file has come in two batches, the first of them twice."""
    file, products, listings = _import(spark, sf_dir)
    folder = f"{shared_root(spark)}/imports-{uuid.uuid4().hex}"
    keyed.put(spark, f"{folder}/products", products, imports.PRODUCTS, ("key",), 0)
    keyed.put(spark, f"{folder}/listings", listings, imports.LISTINGS, ("key", "url"), 0)
    for batch, half in ((1, 0), (1, 0), (2, 1)):
        imports.load(spark, folder, file.where(F.col("half") == half), batch)
    return keyed.read(spark, f"{folder}/products", imports.PRODUCTS)


#: Products before a roll-up and what their listings are, as rules over keys; SQL of both engines.
_BEFORE = """p_partkey AS product_id, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS current_price, CASE WHEN p_partkey % 6 = 1 THEN p_retailprice - 1 END AS previous_price,
  CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice - 300 END AS lowest_price, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice + 300 END AS highest_price, 'pending' AS scrape_status, p_size AS failure_count,
  CASE WHEN p_partkey % 2 = 0 THEN 'timeout' END AS last_error"""
_CHECKED = """product_id, competitor_id, price, (product_id + competitor_id) % 4 <> 0 AND product_id % 10 <> 0 AS is_active,
  CASE WHEN product_id % 4 = 1 THEN 'failed' WHEN (product_id * 3 + competitor_id) % 5 = 0 THEN 'success' ELSE 'failed' END AS scrape_status, CASE WHEN product_id % 8 <> 5 THEN updated_at END AS last_checked_at"""


def product_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products rolled up from their listings, of which those of some products aren't in use, weren't checked or failed; some products have none."""
    before = tables.table(spark, sf_dir, "part").selectExpr(*_split(_BEFORE), "CAST(NULL AS TIMESTAMP_NTZ) AS last_checked_at")
    listings = tables.listings(spark, sf_dir).where("product_id % 200 < 190").selectExpr("product_id", "competitor_id", "price", *_split(_CHECKED.split("price, ", 1)[1]))
    return market.rolled_up(before, listings)


QUERIES = {f.__name__: f for f in (catalog_filter_page, catalog_search_ilike, catalog_stats, catalog_facets, price_list_upsert, bulk_import_status, bulk_import, bulk_import_dry_run, bulk_import_batches, product_states)}

_PRODUCTS_SQL = f"""{LISTINGS_SQL},
products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, p_retailprice AS our_price, current_price, competitor_count, last_checked_at,
    p_size % 5 <> 0 AS is_active, CASE p_size % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'pending' ELSE 'failed' END AS scrape_status,
    CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS target_price
  FROM part LEFT JOIN (SELECT product_id, min(price) AS current_price, count(*) AS competitor_count, max(updated_at) AS last_checked_at FROM listings GROUP BY 1) AS l ON l.product_id = p_partkey)"""


def _import_sql(order: str = "row") -> str:
    return f"""WITH f AS (SELECT {_FILE}, l_orderkey % 2 AS half FROM (SELECT l_orderkey, l_linenumber, {", ".join(f"min({c}) AS {c}" for c in _LEAST)} FROM lineitem GROUP BY ALL)),
p AS (SELECT 'sku:S' || p_partkey AS key, {_HELD}, 'https://shop' || (p_partkey % 40) || '.example.com/p/' || p_partkey AS url FROM part WHERE p_partkey % 3 = 0),
g AS (SELECT * EXCLUDE (u1, u2), coalesce('sku:' || sku, 'row:' || row) AS key, {order} AS ord,
  list_filter([CASE WHEN NOT bare THEN trim(u1) END, CASE WHEN NOT bare THEN trim(u2) END], lambda u: u IS NOT NULL AND u <> '') AS urls FROM f),
h AS (SELECT *, CASE WHEN len(urls) = 0 THEN 'no_urls' ELSE list_filter(list_transform(urls, lambda u: CASE WHEN NOT contains(u, ':') THEN 'invalid' WHEN lower(u) NOT LIKE 'http%://%' THEN 'not_http'
    WHEN regexp_matches(u, '^[^:]+://[^/?#]+/*([?#].*)?$') THEN 'home_page' END), lambda x: x IS NOT NULL)[1] END AS problem, key IN (SELECT key FROM p) AS known FROM g),
s AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'failed' WHEN NOT known AND ord = min(ord) FILTER (WHERE problem IS NULL) OVER (PARTITION BY key) THEN 'created' ELSE 'updated' END AS status FROM h),
l AS (SELECT DISTINCT key, url, first_value(row) OVER (PARTITION BY key, url ORDER BY ord) AS row FROM (SELECT key, ord, row, unnest(urls) AS url FROM s WHERE status <> 'failed') WHERE (key, url) NOT IN (SELECT (key, url) FROM p)),
n AS (SELECT row, count(*) AS listings_added FROM l GROUP BY row),
o AS (SELECT s.*, coalesce(listings_added, 0) AS listings_added FROM s LEFT JOIN n USING (row))"""


ORACLES = {
    "catalog_filter_page": f"""WITH {_PRODUCTS_SQL} SELECT product_id, name, brand, current_price, target_price FROM products
WHERE our_price >= 905 AND our_price <= 1200 AND current_price < target_price AND is_active AND scrape_status = 'failed' ORDER BY current_price DESC NULLS LAST, product_id LIMIT 25 OFFSET 5""",
    "catalog_search_ilike": """SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category FROM part
WHERE (p_name ILIKE '%RED%g%' OR p_brand ILIKE '%RED%g%' OR p_type ILIKE '%RED%g%') AND p_type = 'PROMO'""",
    "catalog_stats": f"""WITH {_PRODUCTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) - count(*) FILTER (WHERE is_active) AS inactive,
  count(*) FILTER (WHERE scrape_status = 'pending') AS never_scraped, count(*) FILTER (WHERE scrape_status = 'failed') AS failing, count(*) FILTER (WHERE current_price < target_price) AS undercut,
  CAST(coalesce(sum(competitor_count), 0) AS BIGINT) AS competitors, {sql_money("CAST(sum(CAST(current_price AS DECIMAL(18,2))) AS DOUBLE) / count(current_price)")} AS average_price, max(last_checked_at) AS last_scrape_at FROM products""",
    "catalog_facets": """SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY 2
UNION ALL SELECT 'category', p_type, count(*) FROM part WHERE p_type <> '' GROUP BY 2 UNION ALL SELECT 'name', p_name, count(*) FROM part WHERE p_name <> '' GROUP BY 2""",
    "price_list_upsert": f"""WITH o AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_retailprice AS price, 'pc' AS unit FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, CASE WHEN p_partkey % 9 <> 0 THEN {sql_money("p_retailprice * CAST(1.1 AS DOUBLE)")} END AS price FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(n.key, o.key) AS key, coalesce(n.name, o.name) AS name, coalesce(n.price, o.price) AS price, o.unit AS unit,
  CASE WHEN n.key IS NULL THEN 'kept' WHEN o.key IS NULL THEN 'imported' WHEN n.name <> o.name OR n.price <> o.price THEN 'updated' ELSE 'unchanged' END AS status
FROM o FULL JOIN n ON o.key = n.key""",
    "bulk_import_status": """SELECT page_id, 'S' || CAST(page_id % 200 AS VARCHAR) AS sku,
  CASE WHEN NOT coalesce(regexp_matches(url, '^https?://[^/?#]+/+[^/?#]'), false) THEN 'failed' WHEN page_id % 200 IN (SELECT s_suppkey FROM supplier) THEN 'updated' ELSE 'created' END AS status FROM pages""",
    "bulk_import": f"{_import_sql()} SELECT row, key, status, listings_added, problem FROM o",
    "bulk_import_dry_run": f"""{_import_sql()}, d AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'failed' WHEN known THEN 'skipped' ELSE 'created' END AS told FROM o)
SELECT count(*) AS received, count(*) FILTER (WHERE told = 'created') AS created, CAST(0 AS BIGINT) AS updated, count(*) FILTER (WHERE told = 'skipped') AS skipped, count(*) FILTER (WHERE told = 'failed') AS failed,
  CAST(coalesce(sum(len(urls)) FILTER (WHERE told = 'created'), 0) AS BIGINT) AS listings_added FROM d""",
    "bulk_import_batches": f"""{_import_sql("half * 1000000000000 + row")},
u AS (SELECT key, max(sku) AS sku, arg_max(name, ord) AS name, arg_max(brand, CASE WHEN brand IS NOT NULL THEN ord END) AS brand, arg_max(category, CASE WHEN category IS NOT NULL THEN ord END) AS category,
  arg_max(our_price, CASE WHEN our_price IS NOT NULL THEN ord END) AS our_price, sum(listings_added) AS added FROM o WHERE status <> 'failed' GROUP BY key)
SELECT coalesce(u.key, p.key) AS key, coalesce(u.sku, p.sku) AS sku, coalesce(u.name, p.name) AS name, coalesce(u.brand, p.brand) AS brand, coalesce(u.category, p.category) AS category,
  coalesce(u.our_price, p.our_price) AS our_price, CAST(coalesce(u.added, 0) + CASE WHEN p.key IS NULL THEN 0 ELSE 1 END AS BIGINT) AS competitor_count FROM u FULL JOIN p ON u.key = p.key""",
    "product_states": f"""WITH {LISTINGS_SQL}, b AS (SELECT {_BEFORE} FROM part), l AS (SELECT {_CHECKED} FROM listings WHERE product_id % 200 < 190),
a AS (SELECT product_id, count(*) FILTER (WHERE is_active) AS n, min(price) FILTER (WHERE is_active) AS cheapest, max(last_checked_at) AS checked, count(*) FILTER (WHERE is_active AND scrape_status = 'success') AS good FROM l GROUP BY 1),
c AS (SELECT product_id, min(competitor_id) AS shop FROM l JOIN a USING (product_id) WHERE is_active AND price = cheapest GROUP BY 1)
SELECT product_id, coalesce(n, 0) AS competitor_count, cheapest AS current_price, CASE WHEN cheapest IS NOT NULL AND cheapest IS DISTINCT FROM b.current_price THEN b.current_price ELSE previous_price END AS previous_price,
  CASE WHEN lowest_price IS NULL OR cheapest < lowest_price THEN coalesce(cheapest, lowest_price) ELSE lowest_price END AS lowest_price, CASE WHEN highest_price IS NULL OR cheapest > highest_price THEN coalesce(cheapest, highest_price) ELSE highest_price END AS highest_price,
  shop AS cheapest_competitor_id, CASE WHEN coalesce(n, 0) = 0 THEN 'skipped' WHEN good > 0 THEN 'success' WHEN checked IS NOT NULL THEN 'failed' ELSE 'pending' END AS scrape_status,
  CASE WHEN good > 0 THEN 0 ELSE failure_count END AS failure_count, CASE WHEN coalesce(good, 0) = 0 THEN last_error END AS last_error, checked AS last_checked_at
FROM b LEFT JOIN a USING (product_id) LEFT JOIN c USING (product_id)""",
}
