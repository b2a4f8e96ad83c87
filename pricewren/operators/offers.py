"""What an offer really costs, how offers are ranked, and which ones answer a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.money import convert, exact_sum, money_round, net_of_tax
from pricewren.functions.text import contains_all, fold_homoglyphs, group_label, query_words

#: An offer counts as an answer from this confidence on; below, it is rejected.
LEAST_CONFIDENCE, SAME_PRODUCT = 0.70, 0.85


def effective_cost(offers: DataFrame, target: str = "EUR", rates: dict[str, float] | None = None) -> DataFrame:
    """offers(price, currency, quantity, discount_percent, vat_state, vat_rate) with discounted, net and effective unit price, line total,
    certainty of the tax (known, assumed) and warnings.

    Each step is rounded to cents. Without a price all amounts are null; without a rate to the target currency, effective price and total are.
    """
    discounted = money_round(F.col("price") * (1 - F.col("discount_percent") / 100))
    rows = offers.withColumn("discounted", discounted).withColumn("net", net_of_tax(F.col("discounted"), F.col("vat_state"), F.col("vat_rate")))
    rows = rows.withColumn("effective", money_round(convert(F.col("net"), F.upper("currency"), F.lit(target), rates)))
    priced = F.col("price").isNotNull()
    warnings = F.array_compact(F.array(
        F.when(F.col("vat_state") == "unknown", F.lit("vat_unknown")),
        F.when(~priced, F.lit("price_unreadable")),
        F.when(priced & F.col("effective").isNull(), F.lit("currency_not_convertible")),
    ))
    certainty = F.when(F.col("vat_state") == "unknown", "assumed").otherwise("known")
    return rows.withColumn("line_total", money_round(F.col("effective") * F.col("quantity"))).withColumn("vat_certainty", certainty).withColumn("warnings", warnings)


def comparable(costs: DataFrame, key: str) -> DataFrame:
    """Where a key's offers are of known and of assumed tax, the assumed ones become uncertain, and so says their warning."""
    w = Window.partitionBy(key)
    mixed = F.bool_or(F.col("vat_certainty") == "known").over(w) & F.bool_or(F.col("vat_certainty") == "assumed").over(w)
    off = F.col("__mixed") & (F.col("vat_certainty") == "assumed")
    warnings = F.when(off, F.array_append(F.array_remove("warnings", "vat_unknown"), "vat_not_comparable")).otherwise(F.col("warnings"))
    return costs.withColumn("__mixed", mixed).withColumn("warnings", warnings).withColumn("vat_certainty", F.when(off, "uncertain").otherwise(F.col("vat_certainty"))).drop("__mixed")


def with_overheads(goods: DataFrame) -> DataFrame:
    """goods(goods_total and a supplier's terms) with shipping (waived from the threshold on, read against the goods), total and minimum."""
    waived = F.col("free_shipping_over").isNotNull() & (F.col("goods_total") >= F.col("free_shipping_over"))
    meets = F.col("goods_total") >= F.col("min_order_value")
    rows = goods.withColumn("shipping_waived", waived).withColumn("shipping", F.when(waived, 0.0).otherwise(money_round(F.col("shipping_cost"))))
    rows = rows.withColumn("total", money_round(F.col("goods_total") + F.col("shipping") + money_round(F.col("handling_fee"))))
    return rows.withColumn("meets_minimum", meets).withColumn("shortfall", F.when(meets, 0.0).otherwise(money_round(F.col("min_order_value") - F.col("goods_total"))))


def supplier_order_cost(lines: DataFrame, terms: DataFrame, key: str = "order_id") -> DataFrame:
    """lines(order_id, supplier_id, line_total) by order and supplier: goods, shipping, handling, total, and what lacks to the minimum."""
    goods = lines.groupBy(key, "supplier_id").agg(
        F.coalesce(exact_sum(F.col("line_total")), F.lit(0.0)).alias("goods_total"), F.count("line_total").alias("lines_priced"), F.count("*").alias("lines_total")
    )
    rows = with_overheads(goods.join(terms.select("supplier_id", "shipping_cost", "free_shipping_over", "handling_fee", "min_order_value"), "supplier_id"))
    return rows.select(key, "supplier_id", "goods_total", "lines_priced", "lines_total", "shipping", "shipping_waived", "total", "meets_minimum", "shortfall")


def rejection(price: Column, confidence: Column, available: Column, excluded: Column, least_confidence: float = LEAST_CONFIDENCE, require_available: bool = False) -> Column:
    """The first reason that rules an offer out; null for one that may be used. A price of 0 is a price."""
    reason = F.when(excluded, "supplier_excluded")
    reason = reason.when(price.isNull() | F.isnan(price) | (price < 0) | (price == float("inf")), "no_price")
    reason = reason.when(confidence < least_confidence, "low_confidence")
    return reason.when(~available, "unavailable") if require_available else reason


def ranked(offers: DataFrame, query: Column, keys: tuple[str, ...] = ("query_id",), limit: int = 60) -> DataFrame:
    """offers(query keys, name, effective, shop_id) in the order of a result list: rank within each query, at most `limit`.

    Offers are grouped by label; groups with a name that holds all words of the query come first, then groups by their cheapest offer, and
    inside a group the cheapest first; offers without a price come last. Unpriced ones that don't match are left out.
    """
    rows = offers.withColumn("matched", contains_all(query_words(query), F.lower(fold_homoglyphs(F.col("name"))))).withColumn("group_label", group_label(F.col("name")))
    rows = rows.where(F.col("effective").isNotNull() | F.col("matched"))
    w = Window.partitionBy(*keys, "group_label")
    rows = rows.withColumn("group_matched", F.bool_or("matched").over(w)).withColumn("group_price", F.min("effective").over(w))
    order = Window.partitionBy(*keys).orderBy(F.desc("group_matched"), F.asc_nulls_last("group_price"), "group_label", F.asc_nulls_last("effective"), "shop_id", "name")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def best_offers(offers: DataFrame, key: str, price: str = "price", tie: str = "competitor_id") -> DataFrame:
    """The cheapest offer of each key among those not stated to be out of stock, else among all."""
    pick = F.struct((~F.coalesce("in_stock", F.lit(True))).alias("out"), F.col(price), F.col(tie))
    best = offers.where(F.col(price).isNotNull()).groupBy(key).agg(F.min(pick).alias("best"))
    return best.select(key, f"best.{tie}", f"best.{price}", (~F.col("best.out")).alias("available"))


def verdict(relation: Column, confidence: Column) -> Column:
    """match, alternative or reject for a candidate; without a relation it is rejected."""
    out = F.when(relation.isNull() | confidence.isNull() | (confidence < LEAST_CONFIDENCE) | relation.isin("conflict", "unrelated"), "reject")
    return out.when((relation == "same_product") & (confidence >= SAME_PRODUCT), "match").when(relation.isin("same_product", "same_family", "compatible"), "alternative").otherwise("reject")


def query_status(verdicts: DataFrame, key: str) -> DataFrame:
    """MATCH if a candidate is one, else ALTERNATIVE, else NO_MATCH, with the numbers of each."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    status = F.when(n("match") > 0, "MATCH").when(n("alternative") > 0, "ALTERNATIVE").otherwise("NO_MATCH")
    return verdicts.groupBy(key).agg(n("match").alias("matches"), n("alternative").alias("alternatives"), n("reject").alias("rejected"), status.alias("status"))


def by_confidence(candidates: DataFrame, key: str, tie: str = "competitor_id", price: str = "price") -> DataFrame:
    """candidates with their place by confidence in bands of a tenth, then price, then tie: a total order in place of one that compares prices only
    where two confidences are closer than a tenth, which is none. Without confidence last, without price last in the band."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(F.floor(F.col("confidence") * 10)), F.asc_nulls_last(price), tie)
    return candidates.withColumn("place", F.row_number().over(order))


def listing_order(listings: DataFrame, key: str) -> DataFrame:
    """Listings with their place on a product's page: primary ones first, then the cheapest, then by name; ties by id."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("is_primary"), F.asc_nulls_last("price"), "name", "competitor_id")
    return listings.withColumn("place", F.row_number().over(order))


def coverage_order(coverage: DataFrame, key: str = "order_id") -> DataFrame:
    """Suppliers of an order with their place: most lines covered first, then the lowest total."""
    order = Window.partitionBy(key).orderBy(F.desc("covered"), F.asc_nulls_last("total"), "supplier_id")
    return coverage.withColumn("place", F.row_number().over(order))


def relation_group(relation: Column, confidence: Column) -> Column:
    """strong, possible, similar or excluded: where a relation stands in a list of answers."""
    out = F.when(relation.isin("conflict", "unrelated"), "excluded").when((relation == "same_product") & (confidence >= SAME_PRODUCT), "strong")
    return out.when(relation.isin("same_product", "compatible", "possible"), "possible").when(relation.isNotNull(), "similar")
