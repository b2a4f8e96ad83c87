"""Shapes of joins and per-key numbering that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.text import host_suffixes


def with_counts(rows: DataFrame, key: str, details: DataFrame, detail_key: str, counts: dict[str, Column]) -> DataFrame:
    """rows with conditional counts of their details; details are summed before the join, so no key meets more than one row of them."""
    sums = details.groupBy(F.col(detail_key).alias(key)).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    return rows.join(sums, key, "left").select(*rows.columns, *[F.coalesce(k, F.lit(0)).alias(k) for k in counts])


def top_of_arrays(rows: DataFrame, array: str, top: int, name: str = "value") -> DataFrame:
    """The most frequent members of an array column."""
    counted = rows.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), name).limit(top)


def host_matches(pages: DataFrame, shops: DataFrame, host: str = "host") -> DataFrame:
    """Each row of pages with the first shop (by name) whose host equals its own or that it is a subdomain of. An equi-join on the suffixes of
    the hosts, in place of a comparison of all with all; distinct hosts are matched once."""
    hosts = pages.select(host).where(F.col(host).isNotNull()).distinct()
    suffixes = hosts.select(host, F.explode(host_suffixes(F.col(host))).alias("suffix"))
    found = suffixes.join(shops.select(F.col("host").alias("suffix"), "shop_id", "shop_name"), "suffix")
    first = found.groupBy(host).agg(F.min(F.struct("shop_name", "shop_id")).alias("shop"))
    return pages.join(first, host, "left").select(*pages.columns, F.col("shop.shop_id").alias("shop_id"), F.col("shop.shop_name").alias("shop_name"))


def numbered(rows: DataFrame, owner: str, order: list[Column | str], start: DataFrame | None = None, name: str = "number") -> DataFrame:
    """Running numbers for each owner, going on from start(owner, number), the highest given so far."""
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(owner).orderBy(*order)).cast("long"))
    if start is None:
        return rows
    last = start.select(F.col(owner), F.col("number").alias("__last"))
    return rows.join(last, owner, "left").withColumn(name, F.col(name) + F.coalesce("__last", F.lit(0))).drop("__last")


def first_n(rows: DataFrame, keys: list[str | Column], order: list[Column | str], n: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("nth") <= n)


def frozen_changes(before: DataFrame, after: DataFrame, key: str, mutable: tuple[str, ...]) -> DataFrame:
    """Rows of `after` that changed a column outside of `mutable`, or that are gone or new, with the names of such columns."""
    frozen = [c for c in before.columns if c != key and c not in mutable]
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in frozen]))
    kind = F.when(F.col(f"b.{key}").isNull(), "deleted").when(F.col(f"a.{key}").isNull(), "inserted").otherwise("changed")
    out = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), kind.alias("kind"), F.array_join(changed, ",").alias("columns"))
    return out.where("kind <> 'changed' or columns <> ''")
