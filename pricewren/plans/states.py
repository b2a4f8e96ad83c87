"""Queries over states of listings, primary listings, cached answers and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions import states
from pricewren.plans.prices import NOW, stocked_listings
from pricewren.sources import tables
from pricewren.sources.tables import LISTINGS_SQL, table


def supplier_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by state; activity and failures are arithmetic of the keys."""
    k, now = F.col("product_id") + F.col("competitor_id"), F.lit(NOW).cast("timestamp_ntz")
    rows = stocked_listings(spark, sf_dir).withColumn("checked", F.when(k % 13 != 0, F.col("updated_at")))
    state = states.supplier_state(k % 11 != 0, k % 5 - 3, F.when(k % 17 != 0, F.col("price")), F.col("in_stock"), F.col("checked"), now, 24 * 800)
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ((F.col("product_id") * 7 + F.col("competitor_id") * 13) % 100).cast("double") / 100
    return tables.listings(spark, sf_dir).groupBy(states.confidence_band(c).alias("band")).agg(F.count("*").alias("n"))


def primary_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For products without a primary listing, the one to be made primary: the cheapest, then the smallest number."""
    rows = tables.listings(spark, sf_dir)
    primary = rows.where((F.col("product_id") + F.col("competitor_id")) % 37 == 0).select("product_id").distinct()
    best = rows.groupBy("product_id").agg(F.min(F.struct("price", "competitor_id")).alias("b")).select("product_id", "b.competitor_id", "b.price")
    return best.join(primary, "product_id", "left_anti")


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whether an answer of the same user and type within the six hours before can be used."""
    from pyspark.sql.window import Window

    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("before", before)
    hit = F.coalesce(F.col("before") > F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(6)), F.lit(False))
    return rows.groupBy("event_type").agg(F.count("*").alias("asked"), F.count_if(hit).alias("hits"))


def attribute_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a product's name, its brand and type as attributes; the second word shares the first one's key."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    words = F.split("p_name", " ")
    made = states.attribute_map(F.array(pair("word", words[0]), pair("brand", F.col("p_brand")), pair("word", words[1]), pair("word", F.col("p_type"))))
    return table(spark, sf_dir, "part").select("p_partkey", made["word"].alias("first"), made["word_2"].alias("second"), made["word_3"].alias("third"), made["brand"].alias("brand"))


def simulated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.listings(spark, sf_dir)
    return rows.select("product_id", "competitor_id", "price", states.simulated_price(F.col("price"), F.col("product_id"), F.col("competitor_id"), seed=1).alias("next_price"))


QUERIES = {f.__name__: f for f in (supplier_states, confidence_bands, primary_backfill, cached_answers, attribute_map, simulated_observations)}

ORACLES = {
    "supplier_states": f"""WITH {LISTINGS_SQL}, x AS (SELECT *, product_id + competitor_id AS k FROM listings)
SELECT CASE WHEN k % 11 = 0 THEN 'paused' WHEN k % 5 = 4 THEN 'error' WHEN k % 17 = 0 OR price IS NULL THEN 'pending' WHEN k % 7 = 0 THEN 'out'
  WHEN k % 13 = 0 OR updated_at < TIMESTAMP '{NOW}' - INTERVAL 800 DAY THEN 'stale' ELSE 'ok' END AS state, count(*) AS n FROM x GROUP BY 1""",
    "confidence_bands": f"""WITH {LISTINGS_SQL}, x AS (SELECT (product_id * 7 + competitor_id * 13) % 100 AS c FROM listings)
SELECT CASE WHEN c >= 95 THEN 'certain' WHEN c >= 85 THEN 'high' WHEN c >= 70 THEN 'possible' ELSE 'weak' END AS band, count(*) AS n FROM x GROUP BY 1""",
    "primary_backfill": f"""WITH {LISTINGS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, competitor_id) AS nth FROM listings)
SELECT product_id, competitor_id, price FROM x WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM listings AS p WHERE p.product_id = x.product_id AND (p.product_id + p.competitor_id) % 37 = 0)""",
    "cached_answers": """WITH x AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_type, count(*) AS asked, count(*) FILTER (WHERE before > ts - INTERVAL 6 HOUR) AS hits FROM x GROUP BY 1""",
    "attribute_map": "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second, p_type AS third, p_brand AS brand FROM part",
}
