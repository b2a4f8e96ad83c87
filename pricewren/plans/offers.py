"""Queries over offers: real costs, ranking, verdicts, and baskets of an order's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions.money import BGN_PER_EUR, convert
from pricewren.operators import basket, offers
from pricewren.plans.prices import stocked_listings
from pricewren.sources import tables
from pricewren.sources.tables import LISTINGS_SQL, TERMS_SQL, sql_money, table

USD_PER_EUR = 1.08
RATES = {"USD": USD_PER_EUR}
QUERY = "red ring"


def listing_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with their supplier's terms; some prices are missing, quantities are arithmetic of the product."""
    price = F.when((F.col("product_id") + F.col("competitor_id")) % 31 != 0, F.col("price"))
    rows = tables.listings(spark, sf_dir).select("product_id", F.col("competitor_id").alias("supplier_id"), price.alias("price"), (F.col("product_id") % 10 + 1).cast("double").alias("quantity"))
    return rows.join(tables.supplier_terms(spark, sf_dir), "supplier_id")


def effective_line_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = offers.effective_cost(listing_offers(spark, sf_dir))
    return costs.select("product_id", "supplier_id", "discounted", "net", "effective", "line_total", "vat_certainty", F.array_join("warnings", ",").alias("warnings"))


def vat_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = offers.comparable(offers.effective_cost(listing_offers(spark, sf_dir), rates=RATES), "product_id")
    return costs.select("product_id", "supplier_id", "effective", "vat_certainty", F.array_join("warnings", ",").alias("warnings"))


def supplier_order_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = tables.supplier_terms(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"))
    costs = offers.effective_cost(lines.join(terms, "supplier_id"))
    return offers.supplier_order_cost(costs, terms)


def currency_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("source", F.element_at(F.array(*[F.lit(c) for c in ("EUR", "BGN", "USD", "GBP")]), (F.col("s_suppkey") % 4 + 1).cast("int")))
    to = lambda c: convert(F.col("s_acctbal"), F.col("source"), F.lit(c), RATES).alias(f"in_{c.lower()}")
    return rows.select("s_suppkey", "source", to("EUR"), to("BGN"), to("USD"))


def rank_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.products(spark, sf_dir).select("product_id", "name", F.col("size").alias("query_id"))
    rows = offers.effective_cost(listing_offers(spark, sf_dir), rates=RATES).join(names, "product_id").withColumn("shop_id", F.col("supplier_id") * 1_000_000 + F.col("product_id"))
    return offers.ranked(rows, F.lit(QUERY)).select(F.col("query_id").cast("long").alias("query_id"), "rank", "product_id", "supplier_id", "effective", "group_label", "matched")


def best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.best_offers(stocked_listings(spark, sf_dir), "product_id")


def verdict_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over listings whose relation and confidence are arithmetic of the keys."""
    kinds = ("same_product", "same_family", "compatible", "same_type", "unrelated", "conflict")
    k = F.col("product_id") * 7 + F.col("competitor_id") * 13
    relation = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % len(kinds) + 1).cast("int"))
    rows = tables.listings(spark, sf_dir).withColumn("verdict", offers.verdict(relation, F.when(k % 11 != 0, (k % 100).cast("double") / 100)))
    return offers.query_status(rows, "product_id")


def offer_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing_offers(spark, sf_dir)
    k = F.col("product_id") + F.col("supplier_id")
    reason = offers.rejection(F.col("price"), (k % 10).cast("double") / 10, F.when(k % 6 != 0, k % 5 != 0), F.col("supplier_id") % 17 == 0, require_available=True)
    return rows.groupBy("supplier_id", F.coalesce(reason, F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt by order, so that what is grouped by order and something else needs no further shuffle."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("line_id"), "l_quantity").repartition("order_id").groupBy("order_id", "line_id").agg(F.sum("l_quantity").alias("quantity"))


def part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings of each part at their real cost."""
    costs = offers.effective_cost(listing_offers(spark, sf_dir), rates=RATES).where("effective is not null")
    return costs.select(F.col("product_id").alias("line_id"), "supplier_id", F.col("effective").alias("unit_price"))


#: The minimums of the tables are far below the value of any order; basket_refusals takes them so many times.
DEAR = 200.0


def _basket(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return order_lines(spark, sf_dir), part_prices(spark, sf_dir), tables.supplier_terms(spark, sf_dir)


def basket_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers cover how much of the orders, and what their goods add up to."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).alias(c)
    some = lambda rows: rows.groupBy("covered", "missing").agg(F.count("*").alias("n"), F.count_if("meets_minimum").alias("accepted"), cents("goods_total"), cents("total"))
    rows = basket.of_coverage(*_basket(spark, sf_dir), some).groupBy("covered", "missing")
    return rows.agg(F.sum("n").alias("n"), F.sum("accepted").alias("accepted"), (F.sum(F.col("goods_total").cast("decimal(20,0)")) / 100).cast("double").alias("goods"), (F.sum(F.col("total").cast("decimal(20,0)")) / 100).cast("double").alias("total"))


def basket_single_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket.of_coverage(*_basket(spark, sf_dir), basket.single_supplier)


def basket_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For orders that no supplier alone serves: who refuses them for their value, with minimums DEAR times as high."""
    lines, offers, terms = _basket(spark, sf_dir)
    terms = terms.withColumn("min_order_value", F.col("min_order_value") * DEAR)
    return basket.of_coverage(lines, offers, terms, lambda cover: basket.refused(cover, terms))


def basket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket.split(*_basket(spark, sf_dir))


def basket_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket.best_sets(*_basket(spark, sf_dir), most=2)


def basket_best_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket.cheapest_sets(*_basket(spark, sf_dir))


def basket_optimal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket.repaired_plans(*_basket(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        effective_line_cost, vat_comparability, supplier_order_cost, currency_convert, rank_offers, best_offer, verdict_partition, offer_rejections, basket_coverage,
        basket_single_supplier, basket_refusals, basket_split, basket_pairwise, basket_best_set, basket_optimal_plan,
    )
}


def costs_sql(source: str, usd: bool) -> str:
    """Columns discounted, net, effective of a relation with price and terms."""
    discounted = sql_money("price * (1 - discount_percent / 100)")
    per_euro = f"CASE currency WHEN 'EUR' THEN CAST(1 AS DOUBLE) WHEN 'BGN' THEN CAST({BGN_PER_EUR} AS DOUBLE)" + (f" WHEN 'USD' THEN CAST({USD_PER_EUR} AS DOUBLE)" if usd else "") + " END"
    return f"""
c1 AS (SELECT *, {discounted} AS discounted FROM {source}),
c2 AS (SELECT *, CASE WHEN vat_state = 'inclusive' AND vat_rate > 0 THEN {sql_money("discounted / (1 + vat_rate / 100)")} ELSE discounted END AS net, {per_euro} AS per_euro FROM c1),
c3 AS (SELECT *, CASE WHEN currency = 'EUR' THEN net ELSE {sql_money("net / per_euro * CAST(1 AS DOUBLE)")} END AS converted FROM c2),
costs AS (SELECT *, {sql_money("converted")} AS effective, {sql_money(sql_money("converted") + " * quantity")} AS line_total,
  CASE WHEN vat_state = 'unknown' THEN 'assumed' ELSE 'known' END AS certainty FROM c3)"""


_OFFERS_SQL = f"""{LISTINGS_SQL}, {TERMS_SQL},
offers AS (SELECT product_id, CASE WHEN (product_id + competitor_id) % 31 <> 0 THEN price END AS price, CAST(product_id % 10 + 1 AS DOUBLE) AS quantity, terms.*
  FROM listings JOIN terms ON supplier_id = competitor_id)"""
_WARN = "CASE WHEN price IS NULL THEN 'price_unreadable' END, CASE WHEN price IS NOT NULL AND effective IS NULL THEN 'currency_not_convertible' END"


def overheads_sql(source: str) -> str:
    return f"""SELECT *, free_shipping_over IS NOT NULL AND goods_total >= free_shipping_over AS shipping_waived,
  CASE WHEN free_shipping_over IS NOT NULL AND goods_total >= free_shipping_over THEN CAST(0 AS DOUBLE) ELSE {sql_money("shipping_cost")} END AS shipping,
  goods_total >= min_order_value AS meets_minimum FROM {source}"""


_OVER = sql_money("goods_total + shipping + " + sql_money("handling_fee"))
_dsum = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
_T = "t.shipping_cost, t.free_shipping_over, t.handling_fee, t.min_order_value"

_LINES_SQL = f"""{_OFFERS_SQL}, {costs_sql("offers", True)},
lines AS (SELECT l_orderkey AS order_id, l_partkey AS line_id, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
wanted AS (SELECT order_id, count(*) AS lines FROM lines GROUP BY 1),
priced AS (SELECT order_id, line_id, c.supplier_id, effective AS unit_price, {sql_money("effective * l.quantity")} AS line_total FROM lines AS l JOIN costs AS c ON c.product_id = line_id WHERE effective IS NOT NULL)"""
_COVER_SQL = f"""{_LINES_SQL},
goods AS (SELECT order_id, p.supplier_id, count(*) AS covered, {_dsum("line_total")} AS goods_total, {_T.replace("t.", "any_value(t.").replace(", any", "), any").replace("_cost)", "_cost) AS shipping_cost").replace("_over)", "_over) AS free_shipping_over").replace("_fee)", "_fee) AS handling_fee")}) AS min_order_value
  FROM priced AS p JOIN terms AS t ON t.supplier_id = p.supplier_id GROUP BY 1, 2),
cover AS (SELECT x.*, {_OVER} AS total, lines - covered AS missing FROM ({overheads_sql("goods")}) AS x JOIN wanted USING (order_id))"""


_EVALUATED_SQL = f"""
picked AS (SELECT s.order_id, s.members, line_id, arg_min(p.supplier_id, (unit_price, p.supplier_id)) AS supplier_id, arg_min(line_total, (unit_price, p.supplier_id)) AS line_total
  FROM sets AS s JOIN priced AS p ON p.order_id = s.order_id AND list_contains(s.members, p.supplier_id) GROUP BY 1, 2, 3),
goods AS (SELECT order_id, members, supplier_id, count(*) AS n, {_dsum("line_total")} AS goods_total FROM picked GROUP BY 1, 2, 3),
g2 AS (SELECT g.*, {_T} FROM goods AS g JOIN terms AS t ON t.supplier_id = g.supplier_id),
plans AS (SELECT order_id, members, sum(n) AS n, list_sort(list(supplier_id)) AS used, {_dsum(_OVER)} AS total, bool_and(meets_minimum) AS viable FROM ({overheads_sql("g2")}) AS x GROUP BY 1, 2),
f AS (SELECT p.*, row_number() OVER (PARTITION BY p.order_id ORDER BY total, len(used), used) AS nth FROM plans AS p JOIN wanted AS w ON w.order_id = p.order_id WHERE viable AND n = lines)
SELECT order_id, array_to_string(used, ',') AS suppliers, len(used) AS n_suppliers, total FROM f WHERE nth = 1"""

#: All pairs of an order's suppliers that cover its lines.
PAIRS_SQL = f"""WITH {_LINES_SQL},
numbered AS (SELECT order_id, line_id, row_number() OVER (PARTITION BY order_id ORDER BY line_id) - 1 AS i FROM lines),
masks AS (SELECT p.order_id, p.supplier_id, bit_or(CAST(1 AS BIGINT) << i) AS m, any_value(w.lines) AS lines FROM priced AS p JOIN numbered AS n ON n.order_id = p.order_id AND n.line_id = p.line_id
  JOIN wanted AS w ON w.order_id = p.order_id GROUP BY 1, 2),
sets AS (SELECT order_id, [supplier_id] AS members FROM masks WHERE m = (CAST(1 AS BIGINT) << lines) - 1
  UNION ALL SELECT a.order_id, [a.supplier_id, b.supplier_id] FROM masks AS a JOIN masks AS b ON b.order_id = a.order_id AND b.supplier_id > a.supplier_id WHERE (a.m | b.m) = (CAST(1 AS BIGINT) << a.lines) - 1 AND a.lines > 1),
{_EVALUATED_SQL}"""



ORACLES = {
    "effective_line_cost": f"""WITH {_OFFERS_SQL}, {costs_sql("offers", False)}
SELECT product_id, supplier_id, discounted, net, effective, line_total, certainty AS vat_certainty, concat_ws(',', CASE WHEN vat_state = 'unknown' THEN 'vat_unknown' END, {_WARN}) AS warnings FROM costs""",
    "vat_comparability": f"""WITH {_OFFERS_SQL}, {costs_sql("offers", True)}, k AS (SELECT product_id, count(DISTINCT certainty) > 1 AS mixed FROM costs GROUP BY 1)
SELECT c.product_id, supplier_id, effective, CASE WHEN mixed AND certainty = 'assumed' THEN 'uncertain' ELSE certainty END AS vat_certainty,
  concat_ws(',', CASE WHEN vat_state = 'unknown' AND NOT mixed THEN 'vat_unknown' END, {_WARN}, CASE WHEN mixed AND certainty = 'assumed' THEN 'vat_not_comparable' END) AS warnings
FROM costs AS c JOIN k ON k.product_id = c.product_id""",
    "supplier_order_cost": f"""WITH {TERMS_SQL}, lines AS (SELECT l_orderkey AS order_id, l_extendedprice / l_quantity AS price, l_quantity AS quantity, terms.* FROM lineitem JOIN terms ON supplier_id = l_suppkey), {costs_sql("lines", False)},
g AS (SELECT order_id, supplier_id, coalesce({_dsum("line_total")}, 0) AS goods_total, count(line_total) AS lines_priced, count(*) AS lines_total, any_value(shipping_cost) AS shipping_cost,
  any_value(free_shipping_over) AS free_shipping_over, any_value(handling_fee) AS handling_fee, any_value(min_order_value) AS min_order_value FROM costs GROUP BY 1, 2)
SELECT order_id, supplier_id, goods_total, lines_priced, lines_total, shipping, shipping_waived, {_OVER} AS total, meets_minimum,
  CASE WHEN meets_minimum THEN CAST(0 AS DOUBLE) ELSE {sql_money("min_order_value - goods_total")} END AS shortfall FROM ({overheads_sql("g")}) AS x""",
    "currency_convert": """WITH x AS (SELECT s_suppkey, s_acctbal AS a, ['EUR', 'BGN', 'USD', 'GBP'][s_suppkey % 4 + 1] AS source FROM supplier),
y AS (SELECT *, CASE source WHEN 'EUR' THEN CAST(1 AS DOUBLE) WHEN 'BGN' THEN CAST(1.95583 AS DOUBLE) WHEN 'USD' THEN CAST(1.08 AS DOUBLE) END AS r FROM x)
SELECT s_suppkey, source, """
    + ", ".join(f"CASE WHEN source = '{c}' THEN a ELSE {sql_money(f'a / r * CAST({v} AS DOUBLE)')} END AS in_{c.lower()}" for c, v in (("EUR", 1.0), ("BGN", BGN_PER_EUR), ("USD", USD_PER_EUR)))
    + " FROM y",
    "rank_offers": f"""WITH {_OFFERS_SQL}, {costs_sql("offers", True)},
h AS (SELECT p_size AS query_id, product_id, supplier_id, effective, p_name AS name, upper(split_part(p_name, ' ', 1)) AS group_label, p_name LIKE '%red%' AND p_name LIKE '%ring%' AS matched FROM costs JOIN part ON p_partkey = product_id),
i AS (SELECT * FROM h WHERE effective IS NOT NULL OR matched),
g AS (SELECT *, bool_or(matched) OVER (PARTITION BY query_id, group_label) AS gm, min(effective) OVER (PARTITION BY query_id, group_label) AS gp FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gm DESC, gp NULLS LAST, group_label, effective NULLS LAST, supplier_id * 1000000 + product_id, name) AS rank FROM g)
SELECT CAST(query_id AS BIGINT) AS query_id, rank, product_id, supplier_id, effective, group_label, matched FROM r WHERE rank <= 60""",
    "best_offer": f"""WITH {LISTINGS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY (product_id + competitor_id) % 7 = 0, price, competitor_id) AS nth FROM listings WHERE price IS NOT NULL)
SELECT product_id, competitor_id, price, (product_id + competitor_id) % 7 <> 0 AS available FROM x WHERE nth = 1""",
    "verdict_partition": f"""WITH {LISTINGS_SQL}, k AS (SELECT product_id, product_id * 7 + competitor_id * 13 AS k FROM listings),
x AS (SELECT product_id, ['same_product', 'same_family', 'compatible', 'same_type', 'unrelated', 'conflict'][k % 6 + 1] AS relation, CASE WHEN k % 11 <> 0 THEN CAST(k % 100 AS DOUBLE) / 100 END AS c FROM k),
v AS (SELECT product_id, CASE WHEN c IS NULL OR c < 0.7 OR relation IN ('unrelated', 'conflict', 'same_type') THEN 'reject' WHEN relation = 'same_product' AND c >= 0.85 THEN 'match' ELSE 'alternative' END AS v FROM x)
SELECT product_id, count(*) FILTER (WHERE v = 'match') AS matches, count(*) FILTER (WHERE v = 'alternative') AS alternatives, count(*) FILTER (WHERE v = 'reject') AS rejected,
  CASE WHEN bool_or(v = 'match') THEN 'MATCH' WHEN bool_or(v = 'alternative') THEN 'ALTERNATIVE' ELSE 'NO_MATCH' END AS status FROM v GROUP BY 1""",
    "offer_rejections": f"""WITH {_OFFERS_SQL}, k AS (SELECT *, product_id + supplier_id AS k FROM offers)
SELECT supplier_id, CASE WHEN supplier_id % 17 = 0 THEN 'supplier_excluded' WHEN price IS NULL THEN 'no_price' WHEN CAST(k % 10 AS DOUBLE) / 10 < CAST(0.7 AS DOUBLE) THEN 'low_confidence'
  WHEN k % 6 <> 0 AND k % 5 = 0 THEN 'unavailable' ELSE 'used' END AS reason, count(*) AS n FROM k GROUP BY 1, 2""",
    "basket_coverage": f"""WITH {_COVER_SQL} SELECT covered, missing, count(*) AS n, count(*) FILTER (WHERE meets_minimum) AS accepted, {_dsum("goods_total")} AS goods, {_dsum("total")} AS total FROM cover GROUP BY 1, 2""",
    "basket_single_supplier": f"""WITH {_COVER_SQL}, x AS (SELECT order_id, supplier_id, total, row_number() OVER (PARTITION BY order_id ORDER BY total, supplier_id) AS nth FROM cover WHERE missing = 0 AND meets_minimum)
SELECT order_id, supplier_id, total FROM x WHERE nth = 1""",
    "basket_refusals": f"""WITH {_COVER_SQL}, able AS (SELECT order_id, supplier_id, goods_total, min_order_value * {DEAR}e0 AS min_order_value,
  max(CASE WHEN goods_total >= min_order_value * {DEAR}e0 THEN 1 ELSE 0 END) OVER (PARTITION BY order_id) AS served FROM cover WHERE missing = 0)
SELECT order_id, supplier_id, goods_total, min_order_value, {sql_money("min_order_value - goods_total")} AS lacking FROM able WHERE served = 0""",
    "basket_split": f"""WITH {_LINES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY order_id, line_id ORDER BY unit_price, supplier_id) AS nth FROM priced),
g AS (SELECT order_id, supplier_id, count(*) AS n, {_dsum("line_total")} AS goods_total FROM b WHERE nth = 1 GROUP BY 1, 2), g2 AS (SELECT g.*, {_T} FROM g JOIN terms AS t ON t.supplier_id = g.supplier_id)
SELECT x.order_id, count(*) AS suppliers, CAST(any_value(lines) - sum(n) AS BIGINT) AS missing, {_dsum("goods_total")} AS goods, {_dsum(_OVER)} AS total, bool_and(meets_minimum) AS viable
FROM ({overheads_sql("g2")}) AS x JOIN wanted AS w ON w.order_id = x.order_id GROUP BY 1""",
    "basket_pairwise": PAIRS_SQL,
}
