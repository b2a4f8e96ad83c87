"""Bulk import of products with the addresses they are sold at, into keyed tables of products and listings.

A file's row has a number (`row`), sku, name, urls (an array) and values. Rows count in the order of their numbers, as if each were saved before the next one is read: the first good row of an
unknown sku creates the product, later ones update it; a value that a row leaves out keeps what was there; an address is added once to each product.
A row without a sku is a product of its own. Rows meet by sku in grouped sums alone, so a sku of very many rows is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.shared import exists
from pricewren.sources import keyed

VALUES = ("brand", "category", "our_price")
PRODUCTS = "key string, sku string, name string, brand string, category string, our_price double, competitor_count long"
LISTINGS = "key string, url string, host string, is_primary boolean"
OUTCOMES = "row long, key string, status string, listings_added long, problem string"


def problem_of(urls: Column) -> Column:
    """no_urls, or what is wrong with the first bad address: invalid, not_http, home_page; null where all are good."""
    bad = lambda u: F.when(~u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "invalid").when(~u.rlike("(?i)^https?:"), "not_http").when(~u.rlike("(?i)^https?://[^/?#\\s]"), "invalid").when(u.rlike("^[^:]+://[^/?#]*/*([?#].*)?$"), "home_page")
    return F.when(F.size(urls) == 0, "no_urls").otherwise(F.try_element_at(F.filter(F.transform(urls, bad), lambda p: p.isNotNull()), F.lit(1)))


def outcomes(incoming: DataFrame, products: DataFrame, listings: DataFrame, update_existing: bool = True, dry_run: bool = False) -> DataFrame:
    """incoming with key, status (created, updated, skipped, failed), listings_added, problem, urls (trimmed, filled ones) and added (places of the urls that are new to the product).

    A dry run looks at each row alone: status by the products that are there, and all its addresses as added.
    """
    trimmed = F.filter(F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda u: F.trim(u)), lambda u: u.isNotNull() & (u != ""))
    given = F.nullif("sku", F.lit(""))
    rows = incoming.withColumn("urls", trimmed).withColumn("sku", given).withColumn("key", F.coalesce(F.concat(F.lit("sku:"), given), F.concat(F.lit("row:"), F.col("row").cast("string"))))
    rows = rows.withColumn("problem", problem_of(F.col("urls"))).join(products.select("key", F.lit(True).alias("known")), "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    good = F.col("problem").isNull()
    if dry_run:
        status = F.when(~good, "failed").when(~F.col("known"), "created").otherwise("updated" if update_existing else "skipped")
        rows = rows.withColumn("status", status)
        return rows.withColumn("listings_added", F.when(F.col("status").isin("created", "updated"), F.size("urls")).otherwise(0).cast("long")).drop("known")
    first = rows.where(good).groupBy("key").agg(F.min("row").alias("first_row"))
    creates = ~F.col("known") & (F.col("row") == F.col("first_row"))
    rows = rows.join(first, "key", "left").withColumn("status", F.when(~good, "failed").when(creates, "created").otherwise("updated" if update_existing else "skipped"))
    each = rows.where(F.col("status").isin("created", "updated")).select("key", "row", F.posexplode("urls").alias("pos", "url"))
    new = each.groupBy("key", "url").agg(F.min(F.struct("row", "pos")).alias("at")).join(listings.select("key", "url"), ["key", "url"], "left_anti")
    counts = new.groupBy("key", F.col("at.row").alias("row")).agg(F.count("*").alias("listings_added"), F.array_sort(F.collect_list("at.pos")).alias("added"))
    out = rows.drop("known", "first_row").join(counts, ["key", "row"], "left")
    return out.withColumn("listings_added", F.coalesce("listings_added", F.lit(0).cast("long")))


def new_listings(result: DataFrame) -> DataFrame:
    """Listings that outcomes add; the first address of a row that creates a product is its primary one."""
    rows = result.where("added IS NOT NULL").select("key", "status", "urls", F.explode("added").alias("pos"))
    url = F.get("urls", F.col("pos"))
    host = F.regexp_extract(F.lower(url), "^https?://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return rows.select("key", url.alias("url"), host.alias("host"), ((F.col("status") == "created") & (F.col("pos") == 0)).alias("is_primary"))


def changed_products(result: DataFrame, products: DataFrame) -> DataFrame:
    """Products as outcomes leave them: the last name, the last value given of each other column, and the number of listings."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("row"))).alias(c)
    rows = result.where("status IN ('created', 'updated')").groupBy("key").agg(F.max("sku").alias("sku"), F.max_by("name", "row").alias("name"), *[last(c) for c in VALUES], F.sum("listings_added").alias("added"))
    new, old = rows.alias("new"), products.alias("old")
    both = new.join(old, F.col("new.key") == F.col("old.key"), "left")
    count = F.col("new.added") + F.coalesce("old.competitor_count", F.lit(0))
    return both.select("new.key", "new.sku", "new.name", *[F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in VALUES], count.alias("competitor_count"))


def tally(result: DataFrame) -> DataFrame:
    """received, created, updated, skipped, failed and listings_added of an import."""
    kinds = [F.count_if(F.col("status") == s).alias(s) for s in ("created", "updated", "skipped", "failed")]
    return result.agg(F.count("*").alias("received"), *kinds, F.coalesce(F.sum("listings_added"), F.lit(0)).alias("listings_added"))


def load(spark: SparkSession, folder: str, incoming: DataFrame, batch: int, update_existing: bool = True, dry_run: bool = False) -> DataFrame:
    """Import a file as a numbered batch and return its outcomes (`OUTCOMES`); a dry run writes nothing.

    Outcomes and changes are written first, then both tables take the changes, each once. So a batch that was cut off anywhere and comes again ends as if it had run once, and a
    batch that is complete returns the outcomes of its first run and changes nothing.
    """
    products, listings = keyed.read(spark, f"{folder}/products", PRODUCTS), keyed.read(spark, f"{folder}/listings", LISTINGS)
    names = [c.split()[0] for c in OUTCOMES.split(", ")]
    if dry_run:
        return outcomes(incoming, products, listings, update_existing, True).select(*names)
    staged = f"{folder}/staged/batch={batch}"
    if not exists(spark, f"{staged}/products/_SUCCESS"):
        made = outcomes(incoming, products, listings, update_existing)
        made.select("row", "key", "sku", "name", *VALUES, "urls", "status", "listings_added", "problem", "added").write.mode("overwrite").parquet(f"{staged}/rows")
        made = spark.read.parquet(f"{staged}/rows")
        new_listings(made).write.mode("overwrite").parquet(f"{staged}/listings")
        changed_products(made, products).write.mode("overwrite").parquet(f"{staged}/products")
    keyed.put(spark, f"{folder}/listings", spark.read.schema(LISTINGS).parquet(f"{staged}/listings"), LISTINGS, ("key", "url"), batch)
    keyed.put(spark, f"{folder}/products", spark.read.schema(PRODUCTS).parquet(f"{staged}/products"), PRODUCTS, ("key",), batch)
    return spark.read.parquet(f"{staged}/rows").select(*names)
