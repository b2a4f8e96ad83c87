"""Queries over orders, decisions and shops: joins, per-owner numbers, savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.money import exact_avg, exact_sum, money_round, plain_round
from pricewren.functions.text import host_of
from pricewren.operators import relations
from pricewren.sources import tables
from pricewren.sources.tables import DECISIONS_SQL, LISTINGS_SQL, SUPPLIERS_SQL, TERMS_SQL, sql_money, sql_plain, table

HOSTS = ("example.com", "ththre.example.com", "example.org", "thther.example.org", "example.net", "store.example.edu")


def alerts_with_optional_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("listing_id"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner"))
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(owners, "o_custkey").join(listing, "o_orderkey", "left")
    return rows.select("o_orderkey", "owner", "o_orderdate", "listing_id")


def decisions_with_order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return relations.with_counts(owners, "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", {"orders": F.lit(True), "confirmed": F.col("o_orderstatus") == "F"})


def top_suppliers_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.top_of_arrays(tables.order_suppliers(spark, sf_dir), "supplier_ids", 5, "supplier_id")


def host_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each host: suppliers, price rows, whether any charges no shipping, and the latest error that is not null."""
    terms = tables.supplier_terms(spark, sf_dir)
    prices = tables.listings(spark, sf_dir).groupBy("competitor_id").agg(F.count("*").alias("n"))
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("supplier_id")).agg(F.max(F.struct("ts", "event_id", "props")).alias("last"))
    rows = terms.join(prices, terms.supplier_id == prices.competitor_id, "left").join(errors, "supplier_id", "left")
    return rows.groupBy("host").agg(
        F.count("*").alias("suppliers"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("price_rows"),
        F.bool_or(F.col("shipping_cost") == 0).alias("any_free"),
        F.max("last").getField("props").alias("latest_error"),
    )


def semi_join_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")))
    return table(spark, sf_dir, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def host_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (F.col("s_suppkey") % len(HOSTS) + 1).cast("int"))
    shops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shop_id"), F.col("s_name").alias("shop_name"), host.alias("host"))
    return relations.host_matches(table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host")), shops)


def array_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.order_suppliers(spark, sf_dir).where(F.arrays_overlap("supplier_ids", F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>")))
    return rows.select("order_id", F.size("supplier_ids").cast("long").alias("suppliers"), F.element_at("supplier_ids", 1).alias("first_supplier"))


def owner_sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner_id"), (F.col("c_custkey") % 7).alias("number"))
    return relations.numbered(tables.decisions(spark, sf_dir), "owner_id", ["created_at", "decision_id"], start).select("owner_id", "decision_id", "number")


def trial_parking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five of each owner stay active, the rest is parked."""
    rows = relations.numbered(tables.decisions(spark, sf_dir), "owner_id", [F.desc("created_at"), F.desc("decision_id")], name="nth")
    return rows.groupBy("owner_id").agg(F.count_if(F.col("nth") <= 5).alias("active"), F.count_if(F.col("nth") > 5).alias("parked"), F.min(F.when(F.col("nth") <= 5, F.col("created_at"))).alias("since"))


def windowed_savings_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings of a month, a year and all time, potential and realised apart, in one scan."""
    at, out = F.col("created_at"), []
    for name, since in (("month", "1999-06-01"), ("year", "1999-01-01"), ("all", None)):
        inside = at >= F.lit(since).cast("timestamp_ntz") if since else F.lit(True)
        for kind in ("potential", "realized"):
            out.append(F.coalesce(exact_sum(F.when(inside & (F.col("savings_kind") == kind), F.col("savings"))), F.lit(0.0)).alias(f"{kind}_{name}"))
        out.append(F.count_if(inside).alias(f"decisions_{name}"))
    return tables.decisions(spark, sf_dir).agg(*out)


def currency_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tables.decisions(spark, sf_dir).groupBy("owner_id", "currency").agg(F.count("*").alias("n"))
    return counted.groupBy("owner_id").agg(F.min_by("currency", F.struct((-F.col("n")).alias("n"), "currency")).alias("currency"))


def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By owner: decisions, mean saving and its share of the baseline, realised ones."""
    rows = tables.decisions(spark, sf_dir).groupBy("owner_id").agg(
        F.count("*").alias("decisions"),
        F.count_if(F.col("savings_kind") == "realized").alias("realized"),
        money_round(exact_avg(F.col("savings"))).alias("mean_saving"),
        exact_sum(F.col("savings")).alias("saved"),
        exact_sum(F.col("baseline_total")).alias("baseline"),
    )
    return rows.withColumn("saved_pct", plain_round(F.try_divide(F.col("saved"), F.col("baseline")) * 100, 1))


def customer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By owner: decisions and savings in all and of the last month and year, confirmed orders, and the five suppliers of most decisions."""
    decisions, at = tables.decisions(spark, sf_dir), F.col("created_at")
    saved = lambda since: F.coalesce(exact_sum(F.when(at >= F.lit(since).cast("timestamp_ntz"), F.col("savings"))), F.lit(0.0))
    totals = decisions.groupBy("owner_id").agg(
        F.count("*").alias("decisions"), F.count_if(F.col("savings_kind") == "realized").alias("realized"), F.max("created_at").alias("latest"),
        F.coalesce(exact_sum(F.col("savings")), F.lit(0.0)).alias("saved"), saved("1999-01-01").alias("saved_year"), saved("1999-06-01").alias("saved_month"),
    )
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), F.col("l_suppkey").alias("supplier_id")).distinct()
    counted = used.join(decisions.select("decision_id", "owner_id"), "decision_id").groupBy("owner_id", "supplier_id").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("n"), "supplier_id"))
    first = counted.withColumn("nth", nth).where("nth <= 5").groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("nth", "supplier_id", "n"))).alias("s"))
    named = first.select("owner_id", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["supplier_id"].cast("string"), x["n"].cast("string"))), ",").alias("top_suppliers"))
    return totals.join(named, "owner_id", "left")


def realised_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions all of whose suppliers confirmed (line status F): the confirmed goods with shipping and handling against the baseline."""
    goods = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("decision_id"), F.col("l_suppkey").alias("supplier_id")).agg(
        exact_sum(F.col("l_extendedprice")).alias("goods"), F.bool_and(F.col("l_linestatus") == "F").alias("confirmed")
    )
    terms = tables.supplier_terms(spark, sf_dir).select("supplier_id", "shipping_cost", "handling_fee")
    costs = goods.join(terms, "supplier_id").groupBy("decision_id").agg(
        F.bool_and("confirmed").alias("confirmed"), exact_sum(F.col("goods")).alias("goods"), exact_sum(F.col("shipping_cost") + F.col("handling_fee")).alias("overhead")
    )
    rows = tables.decisions(spark, sf_dir).join(costs.where("confirmed"), "decision_id")
    total = money_round(F.col("goods") + F.col("overhead"))
    return rows.select("decision_id", total.alias("realized_total"), money_round(F.col("baseline_total") - total).alias("realized_savings"))


def frozen_record_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = tables.decisions(spark, sf_dir)
    k = F.col("decision_id")
    after = before.where(k % 101 != 0).withColumn("savings_kind", F.lit("realized")).withColumn("baseline_total", F.when(k % 97 == 0, F.col("baseline_total") + 1).otherwise(F.col("baseline_total")))
    after = after.withColumn("status", F.when(k % 89 != 0, F.col("status")))
    return relations.frozen_changes(before, after, "decision_id", ("savings_kind", "savings"))


QUERIES = {
    f.__name__: f
    for f in (
        alerts_with_optional_listing, decisions_with_order_counts, top_suppliers_unnest, host_usage, semi_join_active, anti_join_missing, host_suffix_match,
        array_overlap_filter, owner_sequence_numbers, trial_parking, windowed_savings_totals, currency_mode, decision_summary, customer_rollup, realised_savings, frozen_record_diff,
    )
}


def _window_sql() -> str:
    out = []
    for name, since in (("month", "1999-06-01"), ("year", "1999-01-01"), ("all", None)):
        inside = f"created_at >= TIMESTAMP '{since}'" if since else "true"
        for kind in ("potential", "realized"):
            out.append(f"coalesce(CAST(sum(CAST(savings AS DECIMAL(18,2))) FILTER (WHERE {inside} AND savings_kind = '{kind}') AS DOUBLE), 0) AS {kind}_{name}")
        out.append(f"count(*) FILTER (WHERE {inside}) AS decisions_{name}")
    return ", ".join(out)


_dsum = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
_TOTAL = sql_money("goods + overhead")

ORACLES = {
    "alerts_with_optional_listing": """SELECT o_orderkey, c_name AS owner, o_orderdate, l_suppkey AS listing_id FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R') AS l ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""",
    "decisions_with_order_counts": """SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS confirmed FROM customer""",
    "top_suppliers_unnest": f"WITH {SUPPLIERS_SQL} SELECT s.supplier_id, count(*) AS n FROM order_suppliers, unnest(supplier_ids) AS s(supplier_id) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5",
    "host_usage": f"""WITH {LISTINGS_SQL}, {TERMS_SQL}, e AS (SELECT user_id, ts, event_id, props FROM events WHERE event_type = 'error')
SELECT host, count(*) AS suppliers, CAST(coalesce(sum(n), 0) AS BIGINT) AS price_rows, bool_or(shipping_cost = 0) AS any_free,
  (SELECT first(props ORDER BY ts DESC, event_id DESC) FROM e JOIN terms AS u ON u.supplier_id = e.user_id WHERE u.host = t.host) AS latest_error
FROM terms AS t LEFT JOIN (SELECT competitor_id, count(*) AS n FROM listings GROUP BY 1) AS l ON l.competitor_id = t.supplier_id GROUP BY host""",
    "semi_join_active": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1998-01-01')",
    "anti_join_missing": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "host_suffix_match": f"""WITH shops AS (SELECT s_suppkey AS shop_id, s_name AS shop_name, list_value({", ".join(f"'{h}'" for h in HOSTS)})[s_suppkey % {len(HOSTS)} + 1] AS host FROM supplier),
p AS (SELECT page_id, nullif(regexp_extract(lower(trim(url)), '^https?://(?:www\\.)?([^/?#:]+)', 1), '') AS host FROM pages),
m AS (SELECT p.page_id, shop_id, shop_name, row_number() OVER (PARTITION BY page_id ORDER BY shop_name, shop_id) AS nth FROM p JOIN shops AS s ON p.host = s.host OR ends_with(p.host, '.' || s.host))
SELECT p.page_id, p.host, shop_id, shop_name FROM p LEFT JOIN (SELECT * FROM m WHERE nth = 1) AS m ON m.page_id = p.page_id""",
    "array_overlap_filter": f"WITH {SUPPLIERS_SQL} SELECT order_id, len(supplier_ids) AS suppliers, supplier_ids[1] AS first_supplier FROM order_suppliers WHERE list_has_any(supplier_ids, [1, 2, 3])",
    "owner_sequence_numbers": f"""WITH {DECISIONS_SQL} SELECT owner_id, decision_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, decision_id) + coalesce(c_custkey % 7, 0) AS number
FROM decisions LEFT JOIN customer ON c_custkey = owner_id""",
    "trial_parking": f"""WITH {DECISIONS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, decision_id DESC) AS nth FROM decisions)
SELECT owner_id, least(count(*), 5) AS active, greatest(count(*) - 5, 0) AS parked, min(created_at) FILTER (WHERE nth <= 5) AS since FROM x GROUP BY owner_id""",
    "windowed_savings_totals": f"WITH {DECISIONS_SQL} SELECT {_window_sql()} FROM decisions",
    "currency_mode": f"WITH {DECISIONS_SQL} SELECT owner_id, mode(currency ORDER BY currency) AS currency FROM decisions GROUP BY owner_id",
    "decision_summary": f"""WITH {DECISIONS_SQL}, x AS (SELECT owner_id, count(*) AS decisions, count(*) FILTER (WHERE savings_kind = 'realized') AS realized,
  {sql_money(_dsum("savings") + " / count(savings)")} AS mean_saving, {_dsum("savings")} AS saved, {_dsum("baseline_total")} AS baseline FROM decisions GROUP BY owner_id)
SELECT *, {sql_plain("saved / NULLIF(baseline, 0) * 100", 1)} AS saved_pct FROM x""",
    "customer_rollup": f"""WITH {DECISIONS_SQL}, totals AS (SELECT owner_id, count(*) AS decisions, count(*) FILTER (WHERE savings_kind = 'realized') AS realized, max(created_at) AS latest,
  coalesce({_dsum("savings")}, 0) AS saved, coalesce({_dsum("CASE WHEN created_at >= TIMESTAMP '1999-01-01' THEN savings END")}, 0) AS saved_year,
  coalesce({_dsum("CASE WHEN created_at >= TIMESTAMP '1999-06-01' THEN savings END")}, 0) AS saved_month FROM decisions GROUP BY owner_id),
counted AS (SELECT owner_id, l_suppkey AS supplier_id, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN decisions ON decision_id = l_orderkey GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, supplier_id) AS nth FROM counted),
named AS (SELECT owner_id, string_agg(supplier_id || ':' || n, ',' ORDER BY nth) AS top_suppliers FROM placed WHERE nth <= 5 GROUP BY 1)
SELECT totals.*, top_suppliers FROM totals LEFT JOIN named ON named.owner_id = totals.owner_id""",
    "realised_savings": f"""WITH {DECISIONS_SQL}, {TERMS_SQL}, g AS (SELECT l_orderkey, l_suppkey, {_dsum("l_extendedprice")} AS goods, bool_and(l_linestatus = 'F') AS confirmed FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_orderkey, bool_and(confirmed) AS confirmed, {_dsum("goods")} AS goods, {_dsum("shipping_cost + handling_fee")} AS overhead FROM g JOIN terms ON supplier_id = l_suppkey GROUP BY 1)
SELECT decision_id, {_TOTAL} AS realized_total, {sql_money(f"baseline_total - {_TOTAL}")} AS realized_savings FROM decisions JOIN c ON l_orderkey = decision_id WHERE confirmed""",
    "frozen_record_diff": """SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 101 = 0 THEN 'deleted' ELSE 'changed' END AS kind,
  CASE WHEN o_orderkey % 101 = 0 THEN concat_ws(',', 'owner_id', 'created_at', 'status', 'currency', 'baseline_total', 'optimised_total')
    ELSE concat_ws(',', CASE WHEN o_orderkey % 89 = 0 THEN 'status' END, CASE WHEN o_orderkey % 97 = 0 THEN 'baseline_total' END) END AS columns
FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 97 = 0 OR o_orderkey % 89 = 0""",
}
