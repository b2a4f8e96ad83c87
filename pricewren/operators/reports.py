"""Operators' reports over events: percentiles in two readings, last-n figures, streaks, budgets, zero-filled groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.money import plain_round


def p95_nearest_rank(x: str | Column) -> Column:
    """The value at rank ceil(0.95 n)."""
    return F.percentile_disc(F.lit(0.95), x) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {x})")


def p95_floor_index(rows: DataFrame, keys: list[str], value: str, name: str = "p95") -> DataFrame:
    """The value at position floor(0.95 n) from 0, the last one at most: by ranks, so that no key's values meet in one array."""
    w = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("__at", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count("*").over(w))
    return ranked.where(F.col("__at") == F.least(F.col("__n") - 1, F.floor(F.col("__n") * 0.95))).select(*keys, F.col(value).alias(name))


def failure_streaks(events: DataFrame, key: str, failed: Column, order: list[str], least: int) -> DataFrame:
    """Runs of failures: each ends at the next success. key, length and first and last time of runs of `least` or more."""
    w = Window.partitionBy(key).orderBy(*order)
    islands = events.withColumn("__failed", failed).withColumn("__island", F.sum(F.when(F.col("__failed"), 0).otherwise(1)).over(w))
    runs = islands.where("__failed").groupBy(key, "__island").agg(F.count("*").alias("failures"), F.min(order[0]).alias("since"), F.max(order[0]).alias("until"))
    return runs.where(F.col("failures") >= least).drop("__island")


def zero_filled(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of all values of a domain, those that don't occur included."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def last_n(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The newest n rows of all; a top-k, not a sort of everything."""
    return rows.orderBy(*order).limit(n)


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.when(whole > 0, plain_round(part.cast("double") / whole, digits)).otherwise(0.0)


def admitted(rows: DataFrame, keys: list[str | Column], order: list[str], budget: int) -> DataFrame:
    """Rows with whether a daily budget admits them: the first `budget` of each key."""
    return rows.withColumn("admitted", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= budget)


def answer_health(answers: DataFrame, probe: str, shop: str, query: str, url: str) -> DataFrame:
    """Whether a shop's search obeys the query: the sets of addresses it gives for two or more probes are compared.

    error (no probe answered), empty (no addresses at all), ignores_query (the same set for all of several probes), else ok.
    """
    sets = answers.groupBy(shop, query).agg(F.array_sort(F.collect_set(url)).alias("urls"), F.bool_or(probe).alias("ok"))
    by = sets.groupBy(shop).agg(F.bool_or("ok").alias("ok"), F.max(F.size("urls")).alias("most"), F.count_distinct("urls").alias("kinds"), F.count("*").alias("probes"))
    health = F.when(~F.col("ok"), "error").when(F.col("most") == 0, "empty").when((F.col("probes") > 1) & (F.col("kinds") == 1), "ignores_query").otherwise("ok")
    return by.select(shop, health.alias("health"), "probes")


#: How bad the states of a shop's search are; a state that is null is 1.
SEVERITY = {"error": 4, "ignores_query": 3, "empty": 2}


def worst_by_host(shops: DataFrame, owner: str = "owner_id", key: str = "shop_id") -> DataFrame:
    """shops(host, status, detail, owner, key) by host: the worst status with its detail (the smallest key of equally bad ones), its severity and the
    number of owners."""
    severity = F.when(F.col("status").isNull(), 1)
    for state, rank in SEVERITY.items():
        severity = severity.when(F.col("status") == state, rank)
    rows = shops.withColumn("__rank", severity.otherwise(0))
    worst = rows.groupBy("host").agg(F.min(F.struct((-F.col("__rank")).alias("r"), F.col(key).alias("k"), F.col("status").alias("s"), F.col("detail").alias("d"))).alias("w"), F.count_distinct(owner).alias("accounts"))
    return worst.select("host", F.col("w.s").alias("status"), F.col("w.d").alias("detail"), (-F.col("w.r")).cast("int").alias("severity"), "accounts")


def newest_filled(rows: DataFrame, key: str, json: str, order: list[str]) -> DataFrame:
    """Of each key, the newest row whose JSON array has elements, with their number."""
    filled = rows.withColumn("n_elements", F.json_array_length(json)).where("n_elements > 0")
    rest = [c for c in filled.columns if c != key and c not in order]
    newest = filled.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__newest"))
    return newest.select(key, "__newest.*")
