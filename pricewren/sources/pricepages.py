"""Prices out of product pages, by a ladder of column expressions: structured data, then microdata, then meta tags. Comments don't count, and
where a step finds several different prices, none is taken from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.functions.amounts import detect_currency, parse_amount_web
from pricewren.functions.requests import availability

#: Places of a price inside a page's structured data.
PATHS = ("$.offers.price", "$.offers[0].price", "$.offers.lowPrice", "$['@graph'][0].offers.price", "$.mainEntity.offers.price", "$.hasVariant[0].offers.price")
_SCRIPT = "(?is)<script[^>]*application/ld[+]json[^>]*>(.*?)</script>"
_MICRO = "(?is)<[^>]*itemprop=[\"']price[\"'][^>]*content=[\"']([^\"']+)[\"']"
_META = "(?is)<meta[^>]*(?:product|og):price:amount[\"'][^>]*content=[\"']([^\"']+)[\"']"


def _only(values: Column) -> Column:
    """The one distinct amount among texts, null if there are several."""
    found = F.array_distinct(F.array_compact(F.transform(values, parse_amount_web)))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))


def page_prices(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with price, currency, in_stock and strategy (json_ld, microdata, meta; null without a price)."""
    live = F.regexp_replace(F.col(html), "(?s)<!--.*?-->", "")
    blocks = F.regexp_extract_all("__live", F.lit(_SCRIPT), F.lit(1))
    json_price = F.transform(blocks, lambda b: F.coalesce(*[F.get_json_object(b, p) for p in PATHS]))
    currency = F.transform(blocks, lambda b: F.coalesce(*[F.get_json_object(b, p.rsplit(".", 1)[0] + ".priceCurrency") for p in PATHS]))
    visible = F.regexp_replace(F.regexp_replace("__live", "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " ")
    rows = pages.withColumn("__live", live).withColumns({"__json": _only(F.array_compact(json_price)), "__micro": _only(F.regexp_extract_all("__live", F.lit(_MICRO), F.lit(1))), "__meta": _only(F.regexp_extract_all("__live", F.lit(_META), F.lit(1)))})
    rows = rows.withColumns({
        "price": F.coalesce("__json", "__micro", "__meta"),
        "currency": F.coalesce(F.try_element_at(F.array_compact(currency), F.lit(1)), detect_currency(visible)),
        "in_stock": availability(visible),
        "strategy": F.when(F.col("__json").isNotNull(), "json_ld").when(F.col("__micro").isNotNull(), "microdata").when(F.col("__meta").isNotNull(), "meta"),
    })
    return rows.drop("__live", "__json", "__micro", "__meta")


def sitemap_locations(sitemaps: DataFrame, column: str = "xml") -> DataFrame:
    """sitemaps(column) with a row for each address in it."""
    return sitemaps.select(*[c for c in sitemaps.columns if c != column], F.explode(F.regexp_extract_all(column, F.lit("<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1))).alias("url"))


def sitemap_pages(sitemaps: DataFrame, roots: DataFrame, levels: int = 3) -> DataFrame:
    """site, url and level of the pages that are reached from roots(site, url) over sitemaps(url, xml): an index leads to further ones, down to `levels` (the root
    is level 1). A page counts once for each site, at its least level; a sitemap that names itself or one above is read again at most once a level, and one that
    isn't there leads nowhere. Sites without sitemaps have no rows."""
    frontier, found = roots.select("site", "url").distinct(), None
    inside = lambda tag: F.explode(F.regexp_extract_all("xml", F.lit(f"(?s)<{tag}>.*?<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1))).alias("url")
    for level in range(1, levels + 1):
        maps = frontier.join(sitemaps.select("url", "xml"), "url").select("site", "xml")
        pages = maps.select("site", inside("url")).withColumn("level", F.lit(level))
        found = pages if found is None else found.unionByName(pages)
        frontier = maps.select("site", inside("sitemap")).distinct()
    return found.groupBy("site", "url").agg(F.min("level").alias("level"))


def export_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with semicolons and decimal commas."""
    numbers = {c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")) for c, t in rows.dtypes if t in ("double", "float") or t.startswith("decimal")}
    rows.withColumns(numbers).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
