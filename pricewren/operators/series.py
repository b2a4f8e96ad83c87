"""Price series: statistics, changes, all-time lows, retention, alerts. All by windows and grouped aggregates over price observations
(product_id, competitor_id, price, recorded_at, and order_id and line_no to break ties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.money import exact_avg, money_round, percent_change, ratio, trend
from pricewren.sources.tables import SERIES_ORDER

#: Severity of each kind of alert; failures in a row at which a listing is given up, least change in percent, minutes without a repeat.
SEVERITY = {"undercut": "critical", "price_drop": "warning", "price_rise": "info", "all_time_low": "warning", "out_of_stock": "info", "scrape_failing": "warning"}
KINDS = tuple(SEVERITY)
FAILURES, PERCENT, COOLDOWN = 10, 5.0, 60


def in_series(*keys: str) -> Window:
    """Rows of a series in order of time, ties broken by the remaining keys."""
    return Window.partitionBy(*keys).orderBy(*[c for c in SERIES_ORDER if c not in keys])


def series_stats(history: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Points, first, last, least, greatest and mean price, volatility (population deviation in percent of the mean, for two points or more),
    change in percent and trend of each series. One shuffle, with partial aggregation."""
    when = F.struct(*SERIES_ORDER)
    exact = F.col("price").cast("decimal(12,2)")
    rows = history.where("price is not null").groupBy(*keys).agg(
        F.count("*").alias("data_points"),
        F.min_by("price", when).alias("first_price"),
        F.max_by("price", when).alias("last_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        exact_avg(F.col("price")).alias("mean"),
        (F.sum(exact * exact).cast("double") / F.count("*")).alias("square"),
        F.min("recorded_at").alias("first_at"),
        F.max("recorded_at").alias("last_at"),
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")))
    change = percent_change(F.col("first_price"), F.col("last_price"))
    return rows.select(
        *keys, "data_points", "first_price", "last_price", "min_price", "max_price",
        money_round(F.col("mean")).alias("mean_price"),
        F.when(F.col("data_points") >= 2, money_round(ratio(spread, F.col("mean")) * 100)).alias("volatility_pct"),
        change.alias("change_pct"),
        trend(change).alias("trend"),
        "first_at", "last_at",
    )


def with_previous(history: DataFrame) -> DataFrame:
    """Each observation of a listing with the price before it and the change in percent, to four decimals."""
    before = F.lag("price").over(in_series("product_id", "competitor_id"))
    return history.withColumn("previous_price", before).withColumn("change_pct", percent_change(F.col("previous_price"), F.col("price"), 4))


def price_changes(history: DataFrame) -> DataFrame:
    """The observations whose price differs from the listing's previous one; the first of a listing counts."""
    return with_previous(history).where(~F.col("price").eqNullSafe(F.col("previous_price")))


def all_time_lows(history: DataFrame) -> DataFrame:
    """Observations below everything seen of the product before; the first one of a product is none."""
    before = in_series("product_id").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("lowest_before", F.min("price").over(before)).where("price < lowest_before")


def thinned(history: DataFrame, now: Column, full_days: int = 30, keep_days: int = 400) -> DataFrame:
    """Retention: everything of the last full_days, the first observation of each listing and day before, nothing older than keep_days."""
    day = F.date_trunc("day", "recorded_at")
    ties = [c for c in SERIES_ORDER if c != "competitor_id"]
    order = Window.partitionBy("product_id", "competitor_id", day).orderBy(*ties)
    fresh = F.col("recorded_at") >= now - F.make_dt_interval(F.lit(full_days))
    kept = F.col("recorded_at") >= now - F.make_dt_interval(F.lit(keep_days))
    return history.where(kept).withColumn("nth", F.row_number().over(order)).where(fresh | (F.col("nth") == 1)).drop("nth")


def alert_rules(history: DataFrame, products: DataFrame, least_percent: float = 5.0) -> DataFrame:
    """One row for each rule that an observation meets: undercut (below our price), price_drop, price_rise (by least_percent or more) and
    all_time_low; products holds product_id and our_price."""
    before = in_series("product_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = with_previous(history).withColumn("lowest_before", F.min("price").over(before)).join(products.select("product_id", "our_price"), "product_id")
    rules = {
        "undercut": (F.col("price") < F.col("our_price")) & ~F.col("price").eqNullSafe(F.col("previous_price")),
        "price_drop": F.col("change_pct") <= -least_percent,
        "price_rise": F.col("change_pct") >= least_percent,
        "all_time_low": F.col("price") < F.col("lowest_before"),
    }
    met = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(k).alias("type"), F.lit(SEVERITY[k]).alias("severity"))) for k, rule in rules.items()]))
    return rows.withColumn("alert", F.explode(met)).select("product_id", "competitor_id", "recorded_at", "order_id", "line_no", "alert.type", "alert.severity", F.col("previous_price").alias("old_price"), F.col("price").alias("new_price"), "change_pct")


def cooled_down(alerts: DataFrame, keys: tuple[str, ...], at: str, tie: str, minutes: int = 60) -> DataFrame:
    """Alerts that are raised: one is suppressed within `minutes` of the last raised one of its keys. The window starts anew at each raised
    alert, so a key's times are folded in order. Keys are expected to be narrow (a listing and a type); a key's times meet in one row."""
    span = minutes * 60 * 1_000_000
    rows = alerts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(tie).alias("tie")))).alias("seen"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("ties"))

    def step(acc: Column, x: Column) -> Column:
        due = acc["last"].isNull() | (x["us"] - acc["last"] >= span)
        return F.struct(F.when(due, x["us"]).otherwise(acc["last"]).alias("last"), F.when(due, F.concat(acc["ties"], F.array(x["tie"]))).otherwise(acc["ties"]).alias("ties"))

    raised = rows.select(*keys, F.explode(F.aggregate("seen", start, step, lambda acc: acc["ties"])).alias(tie))
    return raised


def observed_alerts(observations: DataFrame, failures: int = FAILURES, percent: float = PERCENT, minutes: int = COOLDOWN) -> DataFrame:
    """All kinds of alerts of observations (product_id, competitor_id, event_id, ts, ok, price, in_stock, target_price), after the cooldown of each listing and kind.

    Without a price an observation is a failed check; at `failures` in a row, and at each more, the listing is failing, and from then on it makes no all-time low,
    which is a price below all that listings in use had of the product before. Failures carry the listing's last two prices. Rows are in order of ts and event_id; one shuffle by
    product, whose windows serve listings as well. Rows without a product or listing are left out.
    """
    rows = observations.where("product_id IS NOT NULL AND competitor_id IS NOT NULL").withColumn("price", F.when(F.col("ok"), F.col("price"))).withColumn("ok", F.col("price").isNotNull())
    # Spark keeps a partitioning by product for windows by (product, listing).
    rows = rows.repartition("product_id")
    listing = Window.partitionBy("product_id", "competitor_id").orderBy("ts", "event_id")
    before = listing.rowsBetween(Window.unboundedPreceding, -1)
    product = Window.partitionBy("product_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    island = Window.partitionBy("product_id", "competitor_id", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("known", F.last("price", ignorenulls=True).over(before))
    pair = F.when(F.col("ok"), F.struct(F.col("known").alias("old_price"), F.col("price").alias("new_price")))
    rows = rows.withColumn("last_pair", F.last(pair, ignorenulls=True).over(before)).withColumn("island", F.count_if("ok").over(listing.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("streak", F.count_if(~F.col("ok")).over(island))
    rows = rows.withColumn("active", F.max("streak").over(listing.rowsBetween(Window.unboundedPreceding, 0)) < failures)
    rows = rows.withColumn("lowest", F.min(F.when(F.col("active"), F.col("price"))).over(product)).withColumn("change", percent_change(F.col("known"), F.col("price"), 4))
    ok, price, change = F.col("ok"), F.col("price"), F.col("change")
    rules = {
        "undercut": ok & (price < F.col("target_price")),
        "price_drop": change <= -percent,
        "price_rise": change >= percent,
        "all_time_low": F.col("active") & (price < F.col("lowest")),
        "out_of_stock": ok & ~F.col("in_stock"),
        "scrape_failing": ~ok & (F.col("streak") >= failures),
    }
    met = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(k).alias("type"), F.lit(SEVERITY[k]).alias("severity"))) for k, rule in rules.items()]))
    old, new = F.when(ok, F.col("known")).otherwise(F.col("last_pair.old_price")), F.when(ok, price).otherwise(F.col("last_pair.new_price"))
    found = rows.select("product_id", "competitor_id", "event_id", "ts", F.explode(met).alias("a"), old.alias("old_price"), new.alias("new_price"), change.alias("change_pct"))
    found = found.select("product_id", "competitor_id", "event_id", "ts", "a.*", "old_price", "new_price", "change_pct")
    due = cooled_down(found, ("product_id", "competitor_id", "type"), "ts", "event_id", minutes)
    return found.drop("ts").join(due, ["product_id", "competitor_id", "type", "event_id"], "left_semi")


def gap_filled_days(rows: DataFrame, at: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by day from the first to the last day, with zeros on days without rows."""
    days = rows.groupBy(F.date_trunc("day", at).alias("day")).agg(*[m.alias(k) for k, m in measures.items()])
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = span.where("a is not null").select(F.explode(F.sequence("a", "b", F.make_dt_interval(F.lit(1)))).alias("day"))
    return every.join(days, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.coalesce(k, F.lit(0)).alias(k) for k in measures])
