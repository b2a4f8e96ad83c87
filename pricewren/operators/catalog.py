"""The product catalogue: optional filters, search, pages, figures, facets, and imports that update it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.functions.money import exact_avg, money_round

#: Columns that pages may be ordered by.
SORTABLE = ("name", "brand", "category", "size", "our_price", "current_price", "last_checked_at")
FACETS = ("brand", "category")


def filtered(products: DataFrame, search: str | None = None, min_price: float | None = None, max_price: float | None = None, undercut_only: bool = False, columns: tuple[str, ...] = ("name", "brand", "category"), **equal) -> DataFrame:
    """Products meeting all conditions that are given. search is looked for in any of `columns`, regardless of case, % and _ as wildcards;
    equal holds values by column, where False is a value and None is no condition."""
    conditions: list[Column] = [F.col(k) == v for k, v in equal.items() if v is not None]
    if search:
        conditions.append(reduce(Column.__or__, [F.col(c).ilike(f"%{search}%") for c in columns]))
    if min_price is not None:
        conditions.append(F.col("our_price") >= min_price)
    if max_price is not None:
        conditions.append(F.col("our_price") <= max_price)
    if undercut_only:
        conditions.append(F.col("target_price").isNotNull() & (F.col("current_price") < F.col("target_price")))
    return products.where(reduce(Column.__and__, conditions)) if conditions else products


def found(rows: DataFrame, text: str, columns: tuple[str, ...], attributes: str | None = None) -> DataFrame:
    """Rows with a text, in any case and taken literally, anywhere in the given columns or the values of a map, read as one text."""
    parts = [F.col(c).cast("string") for c in columns] + ([F.array_join(F.map_values(attributes), " ")] if attributes else [])
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(text.strip().lower())))


def page(rows: DataFrame, by: str, descending: bool = False, key: str = "product_id", limit: int = 20, offset: int = 0) -> DataFrame:
    """One page; rows without a value come last either way, ties go by key. limit is from 1 to 100."""
    if by not in SORTABLE:
        raise ValueError(f"not sortable: {by}")
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return rows.orderBy(order, key).offset(max(0, offset)).limit(min(100, max(1, limit)))


def stats(products: DataFrame) -> DataFrame:
    """The catalogue's figures in one pass."""
    return products.agg(
        F.count("*").alias("total"),
        F.count_if("is_active").alias("active"),
        F.count_if(~F.col("is_active")).alias("inactive"),
        F.count_if(F.col("scrape_status") == "pending").alias("never_scraped"),
        F.count_if(F.col("scrape_status") == "failed").alias("failing"),
        F.count_if(F.col("target_price").isNotNull() & (F.col("current_price") < F.col("target_price"))).alias("undercut"),
        F.coalesce(F.sum("competitor_count"), F.lit(0)).cast("long").alias("competitors"),
        money_round(exact_avg(F.col("current_price"))).alias("average_price"),
        F.max("last_checked_at").alias("last_scrape_at"),
    )


def facets(products: DataFrame, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """Values of each column with their counts, in one shuffle; neither nulls nor empty texts are values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])).alias("p")
    return products.select(pairs).select("p.*").where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def upserted(current: DataFrame, incoming: DataFrame, key: Column | str = "key", values: tuple[str, ...] = ("name", "price", "unit")) -> DataFrame:
    """Rows of both by key, given values replacing old ones and null ones keeping them, with status: kept, updated, unchanged or imported."""
    old, new = current.alias("old"), incoming.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    changed = reduce(Column.__or__, [F.col(f"new.{v}").isNotNull() & ~F.col(f"new.{v}").eqNullSafe(F.col(f"old.{v}")) for v in values])
    status = F.when(F.col(f"new.{key}").isNull(), "kept").when(F.col(f"old.{key}").isNull(), "imported").when(changed, "updated").otherwise("unchanged")
    return both.select(F.coalesce(f"new.{key}", f"old.{key}").alias(str(key)), *[F.coalesce(f"new.{v}", f"old.{v}").alias(v) for v in values], status.alias("status"))


def import_status(incoming: DataFrame, current: DataFrame, url: str = "url", key: str = "sku") -> DataFrame:
    """What an import would do with each row: failed for an address that is none or a home page, updated where the key is known, else created."""
    good = F.col(url).rlike("^https?://[^/?#]+/+[^/?#]")
    known = current.select(key).where(F.col(key).isNotNull()).distinct().withColumn("known", F.lit(True))
    rows = incoming.join(known, key, "left")
    return rows.withColumn("status", F.when(~F.coalesce(good, F.lit(False)), "failed").when(F.col("known"), "updated").otherwise("created")).drop("known")
