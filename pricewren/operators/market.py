"""Products against their market: listings beside our own price, movers, pools, portfolio figures, work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.money import exact_avg, exact_sum, money_round, percent_change


def market_prices(listings: DataFrame) -> DataFrame:
    """The cheapest current price of each product and its number of listings."""
    return listings.groupBy("product_id").agg(F.min("price").alias("market_price"), F.count("*").alias("n_listings"))


def competitor_breakdown(listings: DataFrame) -> DataFrame:
    """Each listing beside its product's cheapest one: premium in percent and whether it is the cheapest."""
    cheapest = F.min("price").over(Window.partitionBy("product_id"))
    rows = listings.withColumn("cheapest", cheapest)
    return rows.select("product_id", "competitor_id", "price", (F.col("price") == F.col("cheapest")).alias("is_cheapest"), percent_change(F.col("cheapest"), F.col("price")).alias("premium_pct"))


def overview(products: DataFrame, listings: DataFrame) -> DataFrame:
    """One row: products, those we win and lose, the mean market price and the mean gap."""
    rows = products.join(market_prices(listings), "product_id", "left")
    ours, market = F.col("our_price"), F.col("market_price")
    both = ours.isNotNull() & market.isNotNull()
    gap = F.when(both, ours.cast("decimal(18,2)") - market.cast("decimal(18,2)"))
    return rows.agg(
        F.count("*").alias("tracked_products"),
        F.coalesce(F.sum("n_listings"), F.lit(0)).cast("long").alias("tracked_listings"),
        F.count_if(both & (ours <= market)).alias("products_we_win"),
        F.count_if(both & (ours > market)).alias("products_we_lose"),
        money_round(exact_avg(market)).alias("average_market_price"),
        money_round(F.sum(gap).cast("double") / F.count(gap)).alias("average_gap"),
    )


def biggest_movers(changes: DataFrame, products: DataFrame, since: Column, top: int = 10) -> DataFrame:
    """The top changes in percent since a time, by size; the top-k runs before the join to product names."""
    rows = changes.where((F.col("recorded_at") >= since) & F.col("change_pct").isNotNull())
    best = rows.orderBy(F.desc(F.abs("change_pct")), F.desc("recorded_at"), "product_id", "competitor_id", "order_id", "line_no", "price").limit(top)
    return best.join(products.select("product_id", "name"), "product_id").select("product_id", "name", "price", money_round(F.col("change_pct")).alias("change_pct"), "recorded_at")


def due(listings: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """Listings never checked or checked longer ago than their product's own interval in minutes."""
    rows = listings.join(products.select("product_id", "interval_minutes"), "product_id")
    late = F.col("updated_at") < F.timestamp_add("MINUTE", -F.col("interval_minutes"), now)
    return rows.where(F.col("updated_at").isNull() | late).select("product_id", "competitor_id", "updated_at", "interval_minutes")


def warehouse_analysis(products: DataFrame, listings: DataFrame) -> DataFrame:
    """For each product its pool of listings: those in stock, or all if none is; best, worst and median price, spread and our margin."""
    any_stock = F.bool_or("in_stock").over(Window.partitionBy("product_id"))
    pool = listings.withColumn("any_stock", any_stock).where("in_stock or not any_stock")
    stats = pool.groupBy("product_id").agg(F.count("*").alias("pool"), F.min("price").alias("best"), F.max("price").alias("worst"), F.median("price").alias("middle"))
    rows = stats.join(products.select("product_id", "our_price"), "product_id")
    return rows.select(
        "product_id", "pool", "best", "worst", money_round(F.col("middle")).alias("median_price"),
        money_round(F.col("worst") - F.col("best")).alias("spread"),
        percent_change(F.col("best"), F.col("worst")).alias("spread_pct"),
        percent_change(F.col("best"), F.col("our_price")).alias("margin_pct"),
        (F.col("best") <= F.col("our_price")).alias("below_target"),
    )


def portfolio_stats(analysis: DataFrame, products: DataFrame) -> DataFrame:
    """One row over all products' analyses: total spread, mean margin, numbers of brands and categories."""
    rows = analysis.join(products.select("product_id", "brand", "category"), "product_id")
    return rows.agg(
        F.count("*").alias("products"),
        exact_sum(F.col("spread")).alias("total_spread"),
        money_round(exact_avg(F.col("margin_pct"))).alias("mean_margin_pct"),
        F.count_distinct("brand").alias("brands"),
        F.count_distinct("category").alias("categories"),
    )


def group_price_range(listings: DataFrame, group: str) -> DataFrame:
    """Range of prices by group, and the best saving where a group holds more than one price."""
    rows = listings.groupBy(group).agg(F.count("*").alias("offers"), F.min("price").alias("lowest"), F.max("price").alias("highest"))
    return rows.select(group, "offers", "lowest", "highest", F.when(F.col("offers") > 1, money_round(F.col("highest") - F.col("lowest"))).otherwise(0.0).alias("saving"))


def rolled_up(products: DataFrame, listings: DataFrame) -> DataFrame:
    """Products as their listings leave them: number of those in use, the cheapest of them (price and listing, the least number of equal ones), the price before it if it moved, lows and highs
    that only widen, and the state: skipped without a listing in use, success (failures and error forgotten) where one of them succeeded, failed where
    the product was checked at all, else as it was.

    products: product_id, current_price, previous_price, lowest_price, highest_price, scrape_status, failure_count, last_error, last_checked_at; listings: product_id,
    competitor_id, price, is_active, scrape_status, last_checked_at. Nulls in is_active or scrape_status count as neither. One shuffle with partial aggregation, and a join by product.
    """
    used = F.coalesce("is_active", F.lit(False))
    best = F.when(used & F.col("price").isNotNull(), F.struct("price", "competitor_id"))
    now = listings.groupBy("product_id").agg(
        F.count_if(used).alias("competitor_count"), F.min(best).alias("best"), F.max("last_checked_at").alias("checked"), F.count_if(used & F.col("scrape_status").eqNullSafe(F.lit("success"))).alias("good"),
    )
    rows = products.join(now, "product_id", "left")
    price, checked, old = F.col("best.price"), F.coalesce("checked", "last_checked_at"), F.col("current_price")
    good = F.coalesce(F.col("good") > 0, F.lit(False))
    status = F.when(F.coalesce("competitor_count", F.lit(0)) == 0, "skipped").when(good, "success").when(checked.isNotNull(), "failed").otherwise(F.col("scrape_status"))
    return rows.select(
        "product_id", F.coalesce("competitor_count", F.lit(0).cast("long")).alias("competitor_count"), price.alias("current_price"),
        F.when(price.isNotNull() & ~price.eqNullSafe(old), old).otherwise(F.col("previous_price")).alias("previous_price"),
        F.least("lowest_price", price).alias("lowest_price"), F.greatest("highest_price", price).alias("highest_price"), F.col("best.competitor_id").alias("cheapest_competitor_id"), status.alias("scrape_status"),
        F.when(good, 0).otherwise(F.col("failure_count")).alias("failure_count"), F.when(~good, F.col("last_error")).alias("last_error"), checked.alias("last_checked_at"),
    )
