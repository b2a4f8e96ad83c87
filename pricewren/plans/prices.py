"""Queries over the price history and the market of each product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.money import money_round
from pricewren.operators import market, series
from pricewren.sources import tables
from pricewren.sources.tables import HISTORY_SQL, LISTINGS_SQL, sql_money

NOW = "2001-11-05 00:00:00"
_SERIES = "recorded_at, competitor_id, order_id, line_no, price"


def sql_pct(before: str, after: str, digits: int = 2) -> str:
    return sql_money(f"(({after}) - ({before})) / NULLIF(CAST({before} AS DOUBLE), 0) * 100", digits)


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def stocked_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a stock state that is arithmetic of the keys."""
    return tables.listings(spark, sf_dir).withColumn("in_stock", (F.col("product_id") + F.col("competitor_id")) % 7 != 0)


def timed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with an interval of checks from 1 to 400 days, in minutes."""
    return tables.products(spark, sf_dir).withColumn("interval_minutes", ((F.col("size") * 8) * 1440).cast("int"))


def product_price_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_stats(tables.price_history(spark, sf_dir))


def competitor_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.competitor_breakdown(tables.listings(spark, sf_dir))


def market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.overview(tables.products(spark, sf_dir), tables.listings(spark, sf_dir))


def biggest_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = series.with_previous(tables.price_history(spark, sf_dir))
    return market.biggest_movers(changes, tables.products(spark, sf_dir), _now() - F.make_dt_interval(F.lit(7)))


def portfolio_listing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = tables.supplier_terms(spark, sf_dir).select("supplier_id", "host")
    rows = tables.listings(spark, sf_dir).join(terms, F.col("competitor_id") == F.col("supplier_id"))
    return rows.agg(F.count("*").alias("listings"), F.count_distinct("host").alias("retailers"), F.count_distinct("product_id").alias("products"))


def price_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each product's history, newest first: 20 rows behind the first 4, with their place and the product's number of rows."""
    newest = Window.partitionBy("product_id").orderBy(*[F.desc(c) for c in series.SERIES_ORDER])
    rows = tables.price_history(spark, sf_dir).withColumn("place", F.row_number().over(newest).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy("product_id")))
    return rows.where(F.col("place").between(5, 24)).select("product_id", "place", "total", "competitor_id", "price", "recorded_at")


def due_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.due(tables.listings(spark, sf_dir), timed_products(spark, sf_dir), _now())
    return rows.orderBy(F.col("updated_at").asc_nulls_first(), "product_id", "competitor_id").limit(25)


def stale_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("updated_at").isNull() | (F.col("updated_at") < _now() - F.make_dt_interval(F.lit(365)))
    rows = tables.listings(spark, sf_dir).where(late)
    best = rows.orderBy(F.col("updated_at").asc_nulls_first(), "product_id", "competitor_id").limit(100)
    return best.join(tables.products(spark, sf_dir).select("product_id", "name"), "product_id").select("product_id", "competitor_id", "name", "price", "updated_at")


def history_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.price_history(spark, sf_dir)
    return series.thinned(rows, _now()).select("product_id", "competitor_id", "price", "recorded_at", "order_id", "line_no")


def history_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention removes, by year."""
    old = F.col("recorded_at") < _now() - F.make_dt_interval(F.lit(400))
    return tables.price_history(spark, sf_dir).where(old).groupBy(F.year("recorded_at").cast("long").alias("year")).agg(F.count("*").alias("expired"))


def price_changes_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.price_changes(tables.price_history(spark, sf_dir))
    return rows.select("product_id", "competitor_id", "recorded_at", "order_id", "line_no", "price", "previous_price", "change_pct")


def all_time_low_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.all_time_lows(tables.price_history(spark, sf_dir)).select("product_id", "competitor_id", "recorded_at", "order_id", "line_no", "price", "lowest_before")


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.alert_rules(tables.price_history(spark, sf_dir), tables.products(spark, sf_dir))


def warehouse_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.warehouse_analysis(tables.products(spark, sf_dir), stocked_listings(spark, sf_dir))


def portfolio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = tables.products(spark, sf_dir)
    return market.portfolio_stats(market.warehouse_analysis(products, stocked_listings(spark, sf_dir)), products)


def group_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.listings(spark, sf_dir).join(tables.products(spark, sf_dir).select("product_id", "name"), "product_id")
    return market.group_price_range(rows, "name")


def latest_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three observations of each product."""
    order = Window.partitionBy("product_id").orderBy(*[F.desc(c) for c in series.SERIES_ORDER])
    rows = tables.price_history(spark, sf_dir).withColumn("nth", F.row_number().over(order)).where("nth <= 3")
    return rows.select("product_id", "competitor_id", "price", "recorded_at", F.col("nth").cast("long").alias("nth"))


def product_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures kept with each product: number of listings, cheapest current price, extremes of all time, newest check."""
    extremes = tables.price_history(spark, sf_dir).groupBy("product_id").agg(F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"))
    now = tables.listings(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("competitor_count"), F.min("price").alias("current_price"), F.max("updated_at").alias("last_checked_at"))
    ours = money_round(F.col("our_price") - F.col("current_price"))
    return tables.products(spark, sf_dir).join(now, "product_id", "left").join(extremes, "product_id", "left").select("product_id", F.coalesce("competitor_count", F.lit(0)).alias("competitor_count"), "current_price", "lowest_price", "highest_price", "last_checked_at", ours.alias("gap"))


QUERIES = {
    f.__name__: f
    for f in (
        product_price_analytics, competitor_breakdown, market_overview, biggest_movers, portfolio_listing_counts, price_history_page, due_listings, stale_listings,
        history_thinning, history_expiry, price_changes_only, all_time_low_events, alert_rules, warehouse_analysis, portfolio_stats, group_price_range, latest_n_per_key,
        product_rollup,
    )
}

_mean = "CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(price)"
_STATS_SQL = f"""
stats AS (
  SELECT product_id, count(*) AS data_points, first(price ORDER BY {_SERIES}) AS first_price, last(price ORDER BY {_SERIES}) AS last_price,
    min(price) AS min_price, max(price) AS max_price, {_mean} AS mean,
    CAST(sum(CAST(price AS DECIMAL(12,2)) * CAST(price AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS square,
    min(recorded_at) AS first_at, max(recorded_at) AS last_at
  FROM history WHERE price IS NOT NULL GROUP BY product_id)"""

_STOCKED_SQL = LISTINGS_SQL + """,
stocked AS (SELECT *, (product_id + competitor_id) % 7 <> 0 AS in_stock FROM listings)"""

_ANALYSIS_SQL = f"""{_STOCKED_SQL},
pool AS (SELECT s.*, bool_or(in_stock) OVER (PARTITION BY product_id) AS any_stock FROM stocked AS s),
pooled AS (SELECT product_id, count(*) AS pool, min(price) AS best, max(price) AS worst, median(price) AS middle FROM pool WHERE in_stock OR NOT any_stock GROUP BY product_id),
analysis AS (
  SELECT product_id, pool, best, worst, {sql_money("middle")} AS median_price, {sql_money("worst - best")} AS spread,
    {sql_pct("best", "worst")} AS spread_pct, {sql_pct("best", "p_retailprice")} AS margin_pct, best <= p_retailprice AS below_target, p_brand, p_type
  FROM pooled JOIN part ON p_partkey = product_id)"""

_PREVIOUS_SQL = f"""{HISTORY_SQL},
lagged AS (SELECT *, lag(price) OVER (PARTITION BY product_id, competitor_id ORDER BY recorded_at, order_id, line_no, price) AS previous_price FROM history),
changes AS (SELECT *, {sql_pct("previous_price", "price", 4)} AS change_pct FROM lagged)"""

_LOW = "min(price) OVER (PARTITION BY product_id ORDER BY recorded_at, competitor_id, order_id, line_no, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

ORACLES = {
    "product_price_analytics": f"""WITH {HISTORY_SQL}, {_STATS_SQL},
x AS (SELECT *, {sql_pct("first_price", "last_price")} AS change_pct FROM stats)
SELECT product_id, data_points, first_price, last_price, min_price, max_price, {sql_money("mean")} AS mean_price,
  CASE WHEN data_points >= 2 THEN {sql_money("sqrt(greatest(CAST(0 AS DOUBLE), square - mean * mean)) / NULLIF(mean, 0) * 100")} END AS volatility_pct, change_pct,
  CASE WHEN change_pct IS NULL THEN 'unknown' WHEN change_pct > 1 THEN 'rising' WHEN change_pct < -1 THEN 'falling' ELSE 'flat' END AS trend, first_at, last_at
FROM x""",
    "competitor_breakdown": f"""WITH {LISTINGS_SQL}, c AS (SELECT product_id, min(price) AS cheapest FROM listings GROUP BY product_id)
SELECT l.product_id, competitor_id, price, price = cheapest AS is_cheapest, {sql_pct("cheapest", "price")} AS premium_pct FROM listings AS l JOIN c ON c.product_id = l.product_id""",
    "market_overview": f"""WITH {LISTINGS_SQL}, m AS (SELECT product_id, min(price) AS market_price, count(*) AS n FROM listings GROUP BY product_id),
x AS (SELECT p_retailprice AS ours, market_price AS market, n FROM part LEFT JOIN m ON product_id = p_partkey)
SELECT count(*) AS tracked_products, CAST(coalesce(sum(n), 0) AS BIGINT) AS tracked_listings, count(*) FILTER (WHERE ours <= market) AS products_we_win,
  count(*) FILTER (WHERE ours > market) AS products_we_lose, {sql_money("CAST(sum(CAST(market AS DECIMAL(18,2))) AS DOUBLE) / count(market)")} AS average_market_price,
  {sql_money("CAST(sum(CAST(ours AS DECIMAL(18,2)) - CAST(market AS DECIMAL(18,2))) AS DOUBLE) / count(CASE WHEN ours IS NOT NULL THEN market END)")} AS average_gap
FROM x""",
    "biggest_movers": f"""WITH {_PREVIOUS_SQL}, top AS (
  SELECT * FROM changes WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND change_pct IS NOT NULL
  ORDER BY abs(change_pct) DESC, recorded_at DESC, product_id, competitor_id, order_id, line_no, price LIMIT 10)
SELECT product_id, p_name AS name, price, {sql_money("change_pct")} AS change_pct, recorded_at FROM top JOIN part ON p_partkey = product_id""",
    "portfolio_listing_counts": f"""WITH {LISTINGS_SQL}, {tables.TERMS_SQL}
SELECT count(*) AS listings, count(DISTINCT host) AS retailers, count(DISTINCT product_id) AS products FROM listings JOIN terms ON supplier_id = competitor_id""",
    "price_history_page": f"""WITH {HISTORY_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, competitor_id DESC, order_id DESC, line_no DESC, price DESC) AS place,
  count(*) OVER (PARTITION BY product_id) AS total FROM history)
SELECT product_id, place, total, competitor_id, price, recorded_at FROM x WHERE place BETWEEN 5 AND 24""",
    "due_listings": f"""WITH {LISTINGS_SQL} SELECT product_id, competitor_id, updated_at, p_size * 8 * 1440 AS interval_minutes FROM listings JOIN part ON p_partkey = product_id
WHERE updated_at IS NULL OR updated_at < TIMESTAMP '{NOW}' - to_minutes(CAST(p_size * 8 * 1440 AS BIGINT)) ORDER BY updated_at NULLS FIRST, product_id, competitor_id LIMIT 25""",
    "stale_listings": f"""WITH {LISTINGS_SQL}, late AS (SELECT * FROM listings WHERE updated_at IS NULL OR updated_at < TIMESTAMP '{NOW}' - INTERVAL 365 DAY
  ORDER BY updated_at NULLS FIRST, product_id, competitor_id LIMIT 100)
SELECT product_id, competitor_id, p_name AS name, price, updated_at FROM late JOIN part ON p_partkey = product_id""",
    "history_thinning": f"""WITH {HISTORY_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, competitor_id, date_trunc('day', recorded_at) ORDER BY recorded_at, order_id, line_no, price) AS nth
  FROM history WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY)
SELECT product_id, competitor_id, price, recorded_at, order_id, line_no FROM numbered WHERE nth = 1 OR recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY""",
    "history_expiry": f"""SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS expired FROM lineitem WHERE l_shipdate < TIMESTAMP '{NOW}' - INTERVAL 400 DAY GROUP BY 1""",
    "price_changes_only": f"""WITH {_PREVIOUS_SQL} SELECT product_id, competitor_id, recorded_at, order_id, line_no, price, previous_price, change_pct
FROM changes WHERE price IS DISTINCT FROM previous_price""",
    "all_time_low_events": f"""WITH {HISTORY_SQL}, x AS (SELECT *, {_LOW} AS lowest_before FROM history)
SELECT product_id, competitor_id, recorded_at, order_id, line_no, price, lowest_before FROM x WHERE price < lowest_before""",
    "alert_rules": f"""WITH {_PREVIOUS_SQL}, y AS (SELECT *, {_LOW} AS lowest_before FROM changes), x AS (SELECT y.*, p_retailprice AS our_price FROM y JOIN part ON p_partkey = product_id),
a AS (
  SELECT *, 'undercut' AS type, 'critical' AS severity FROM x WHERE price < our_price AND price IS DISTINCT FROM previous_price
  UNION ALL SELECT *, 'price_drop', 'warning' FROM x WHERE change_pct <= -5
  UNION ALL SELECT *, 'price_rise', 'info' FROM x WHERE change_pct >= 5
  UNION ALL SELECT *, 'all_time_low', 'warning' FROM x WHERE price < lowest_before)
SELECT product_id, competitor_id, recorded_at, order_id, line_no, type, severity, previous_price AS old_price, price AS new_price, change_pct FROM a""",
    "warehouse_analysis": f"WITH {_ANALYSIS_SQL} SELECT product_id, pool, best, worst, median_price, spread, spread_pct, margin_pct, below_target FROM analysis",
    "portfolio_stats": f"""WITH {_ANALYSIS_SQL} SELECT count(*) AS products, CAST(sum(CAST(spread AS DECIMAL(18,2))) AS DOUBLE) AS total_spread,
  {sql_money("CAST(sum(CAST(margin_pct AS DECIMAL(18,2))) AS DOUBLE) / count(margin_pct)")} AS mean_margin_pct, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS categories FROM analysis""",
    "group_price_range": f"""WITH {LISTINGS_SQL} SELECT p_name AS name, count(*) AS offers, min(price) AS lowest, max(price) AS highest,
  CASE WHEN count(*) > 1 THEN {sql_money("max(price) - min(price)")} ELSE CAST(0 AS DOUBLE) END AS saving FROM listings JOIN part ON p_partkey = product_id GROUP BY p_name""",
    "latest_n_per_key": f"""WITH {HISTORY_SQL}, x AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, competitor_id DESC, order_id DESC, line_no DESC, price DESC) AS nth FROM history)
SELECT product_id, competitor_id, price, recorded_at, nth FROM x WHERE nth <= 3""",
    "product_rollup": f"""WITH {LISTINGS_SQL}, e AS (SELECT product_id, min(price) AS lowest_price, max(price) AS highest_price FROM history GROUP BY 1),
n AS (SELECT product_id, count(*) AS competitor_count, min(price) AS current_price, max(updated_at) AS last_checked_at FROM listings GROUP BY 1)
SELECT p_partkey AS product_id, coalesce(competitor_count, 0) AS competitor_count, current_price, lowest_price, highest_price, last_checked_at, {sql_money("p_retailprice - current_price")} AS gap
FROM part LEFT JOIN n ON n.product_id = p_partkey LEFT JOIN e ON e.product_id = p_partkey""",
}
