"""Queries over accounts, drafts, shops' health and result orders, and the engine's SQL surface."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions import accounts, text
from pricewren.operators import basket, catalog, offers, reports
from pricewren.plans.offers import _COVER_SQL, order_lines, part_prices
from pricewren.sources import pricepages, surface, tables
from pricewren.sources.tables import LISTINGS_SQL, TERMS_SQL, sql_money, table

PLANS = tuple(accounts.PLAN_PRODUCTS)
STATES = ("ok", "empty", "ignores_query", "error")
RELATIONS = ("same_product", "same_family", "compatible", "same_type", "unrelated", "conflict")
NOW = datetime.datetime(1999, 6, 30)
KEY = b"drafts of the tests"


def _one_of(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def plan_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a plan by their key: products under watch are their orders, comparisons those of the period since the latest order."""
    now = F.lit(NOW).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("watched"), F.max(F.when(F.col("o_orderdate") <= now, F.col("o_orderdate"))).alias("started"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", _one_of(PLANS, F.col("c_custkey")).alias("plan")).join(orders, "c_custkey", "left")
    watched, used = F.coalesce("watched", F.lit(0)), accounts.used_in_period(F.coalesce("watched", F.lit(0)) * 9, F.col("started"), now)
    limit, comparisons = accounts.limit_of(F.col("plan"), accounts.PLAN_PRODUCTS), accounts.limit_of(F.col("plan"), accounts.PLAN_COMPARISONS)
    return rows.select("c_custkey", "plan", (watched < limit).alias("may_add"), used.alias("used"), F.greatest(comparisons - used, F.lit(0)).alias("left"), (used < comparisons).alias("within_budget"))


def shop_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the hosts of pages, moved under five kinds of domain."""
    shape = F.col("page_id") % 5
    host = text.host_of(F.col("url"))
    moved = F.when(shape == 0, F.concat(host, F.lit(".bg"))).when(shape == 1, F.concat(F.lit("www.ro."), host)).when(shape == 2, F.concat(host, F.lit(".GR"))).when(shape == 3, F.concat(F.lit("shop.el."), host)).otherwise(host)
    return table(spark, sf_dir, "pages").select("page_id", accounts.locale_of(moved).alias("locale"))


def sealed_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts in one form of JSON with their seal, whether it opens half an hour later, and whether a changed one does."""
    rows = table(spark, sf_dir, "orders")
    lines = F.array(F.col("o_orderpriority"), F.col("o_orderstatus"))
    draft = rows.select("o_orderkey", F.col("o_orderdate").alias("issued"), F.struct(F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("owner"), lines.alias("lines"), F.lit(None).cast("string").alias("note")).alias("draft"))
    sealed = draft.withColumn("payload", accounts.canonical_json(F.col("draft"), draft.schema["draft"].dataType)).withColumn("seal", accounts.sealed(F.col("payload"), F.col("issued"), KEY))
    later = F.col("issued") + F.make_dt_interval(F.lit(0), F.lit(0), F.when(F.col("o_orderkey") % 3 == 0, 90).otherwise(30))
    return sealed.select("o_orderkey", "payload", "seal", accounts.opens(F.col("payload"), F.col("issued"), F.col("seal"), later, KEY).alias("opens"), accounts.opens(F.concat("payload", F.lit(" ")), F.col("issued"), F.col("seal"), later, KEY).alias("changed_opens"))


def worst_health_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = tables.supplier_terms(spark, sf_dir).select(F.col("supplier_id").alias("shop_id"), "host")
    k = F.col("s_suppkey")
    state = F.when(k % 7 != 0, _one_of(STATES, F.floor(k / 40)))
    shops = table(spark, sf_dir, "supplier").select(k.alias("shop_id"), state.alias("status"), F.col("s_name").alias("detail"), F.col("s_nationkey").alias("owner_id"))
    return reports.worst_by_host(shops.join(terms, "shop_id"))


def client_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose product, attributes or supplier hold a text."""
    products = tables.products(spark, sf_dir).withColumn("attributes", F.create_map(F.lit("size"), F.concat(F.lit("W"), F.col("size").cast("string")), F.lit("kind"), F.col("category")))
    rows = tables.listings(spark, sf_dir).join(products, "product_id").join(tables.supplier_terms(spark, sf_dir).withColumnRenamed("supplier_id", "competitor_id"), "competitor_id")
    return catalog.found(rows, " W4", ("name", "brand", "supplier_name", "host"), "attributes").select("product_id", "competitor_id")


def newest_filled_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest cached answer of each user that isn't empty; answers are JSON arrays of as many numbers as their key says."""
    n = F.get_json_object("props", "$.k").cast("int") % 4
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.to_json(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, n)).alias("products"))
    return reports.newest_filled(rows, "user_id", "products", ["ts", "event_id"]).select("user_id", "event_id", "n_elements")


def confidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("product_id") * 7 + F.col("competitor_id") * 13
    confidence = F.when(k % 11 != 0, (k % 100).cast("double") / 100)
    rows = tables.listings(spark, sf_dir).withColumn("confidence", confidence).withColumn("relation", _one_of(RELATIONS, k))
    placed = offers.by_confidence(rows, "product_id")
    return placed.select("product_id", "competitor_id", "place", offers.relation_group(F.col("relation"), F.col("confidence")).alias("answer_group"))


def listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.supplier_terms(spark, sf_dir).select(F.col("supplier_id").alias("competitor_id"), F.col("supplier_name").alias("name"))
    rows = tables.listings(spark, sf_dir).join(names, "competitor_id").withColumn("is_primary", (F.col("product_id") + F.col("competitor_id")) % 9 == 0)
    return offers.listing_order(rows, "product_id").select("product_id", "competitor_id", "place")


def coverage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by order in the order of their coverage: how often each stands in which place."""
    counted = lambda cover: basket.places(cover).groupBy("supplier_id", "place").agg(F.count("*").alias("n"))
    rows = basket.of_coverage(order_lines(spark, sf_dir), part_prices(spark, sf_dir), tables.supplier_terms(spark, sf_dir), counted)
    return rows.groupBy("supplier_id", "place").agg(F.sum("n").alias("n"))


def query_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as a buyer types them, in the shops' spelling, and spellings of an article number."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    asked = F.concat(F.col("p_name"), F.lit(" "), size, F.when(k % 3 == 0, "x").when(k % 3 == 1, " х ").otherwise(" по "), F.lit("2"), F.when(k % 2 == 0, ".").otherwise(","), F.lit("5"))
    codes = text.identifier_spellings(F.concat(F.upper(F.substring("p_name", 1, 3)), F.when(k % 3 == 0, "-").when(k % 3 == 1, " / ").otherwise(""), size))
    return table(spark, sf_dir, "part").select("p_partkey", text.respelled(asked).alias("respelled"), F.array_join(codes, "|").alias("codes"))


def names_from_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/kabel-svt_do%201--mm2/?a=b"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.name_from_url(url).alias("name"))


def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of the benchmark's texts with their stems."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", text.stem(F.col("word")).alias("stem"))


def page_price_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a price put into them in one of four ways, or two that differ, and what the ladder reads."""
    k = F.col("page_id")
    price = F.concat((k % 900 + 100).cast("string"), F.lit(".5"))
    data = lambda p: F.concat(F.lit('<script type="application/ld+json">{"offers": {"price": "'), p, F.lit('", "priceCurrency": "EUR"}}</script>'))
    micro = F.concat(F.lit('<span itemprop="price" content="'), price, F.lit('"></span>'))
    meta = F.concat(F.lit('<meta property="product:price:amount" content="'), price, F.lit('">'))
    added = F.when(k % 5 == 0, data(price)).when(k % 5 == 1, micro).when(k % 5 == 2, meta).when(k % 5 == 3, F.concat(data(price), data(F.lit("7.25")), micro)).otherwise(F.concat(F.lit("<!--"), micro, F.lit("-->")))
    rows = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", added))
    return pricepages.page_prices(rows).select("page_id", "price", "strategy")


def sitemap_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses out of sitemaps, one made of each page's address and a second one beside it."""
    xml = F.concat(F.lit("<urlset><url><loc> "), F.col("url"), F.lit(" </loc></url>\n<url><loc>"), F.regexp_replace("url", "[?#].*$", ""), F.lit("/b</loc></url></urlset>"))
    return pricepages.sitemap_locations(table(spark, sf_dir, "pages").select("page_id", xml.alias("xml")))


def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.query(
        spark, sf_dir,
        """SELECT p.brand, count(*) AS listings, count(DISTINCT host_of(concat('https://www.', t.host, '/x'))) AS hosts, max(money_round(l.price * 1.1D)) AS dearest,
             max(canonical_identifier(t.supplier_name)) AS last_code, min(net_price(l.price, t.vat_state, t.vat_rate)) AS cheapest_net, max(change_percent(p.our_price, l.price)) AS largest_change
           FROM products p JOIN listings l ON l.product_id = p.product_id JOIN supplier_terms t ON t.supplier_id = l.competitor_id
           WHERE p.our_price >= :least GROUP BY p.brand""",
        least=905.0,
    )


def sql_request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface.register(spark)
    table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, ';', p_type, ' ; ;', p_brand) AS request").createOrReplaceTempView("requests")
    return spark.sql("SELECT p_partkey, r.line, r.query FROM requests, LATERAL request_rows(request) AS r")


QUERIES = {
    f.__name__: f
    for f in (
        plan_quota, shop_locales, sealed_drafts, worst_health_by_host, client_search, newest_filled_answer, confidence_order, listing_order, coverage_order, query_spellings,
        names_from_urls, word_stems, page_price_ladder, sitemap_addresses, sql_surface, sql_request_rows,
    )
}

_PAD = lambda mask: "".join(f"{b ^ mask:02X}" for b in KEY.ljust(64, b"\0"))
_HOST_SQL = "nullif(regexp_extract(lower(trim(url)), '^https?://(?:www\\.)?([^/?#:]+)', 1), '')"
_CASE = lambda limits: "CASE plan " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in limits.items()) + " END"
_PLACE = lambda order, key="product_id": f"CAST(row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS INTEGER) AS place"

ORACLES = {
    "plan_quota": f"""WITH o AS (SELECT o_custkey, count(*) AS watched, max(o_orderdate) FILTER (WHERE o_orderdate <= TIMESTAMP '{NOW}') AS started FROM orders GROUP BY 1),
x AS (SELECT c_custkey, {list(PLANS)}[c_custkey % 4 + 1] AS plan, coalesce(watched, 0) AS watched, started FROM customer LEFT JOIN o ON o_custkey = c_custkey),
y AS (SELECT *, CASE WHEN started IS NULL OR TIMESTAMP '{NOW}' > started + INTERVAL 30 DAY THEN 0 ELSE watched * 9 END AS used FROM x)
SELECT c_custkey, plan, watched < {_CASE(accounts.PLAN_PRODUCTS)} AS may_add, used, greatest({_CASE(accounts.PLAN_COMPARISONS)} - used, 0) AS left, used < {_CASE(accounts.PLAN_COMPARISONS)} AS within_budget FROM y""",
    "shop_locales": f"SELECT page_id, CASE WHEN {_HOST_SQL} IS NOT NULL THEN ['bg', 'ro', 'el', 'el', 'en'][page_id % 5 + 1] END AS locale FROM pages",
    "sealed_drafts": f"""WITH p AS (SELECT o_orderkey, o_orderdate AS issued, CAST(to_json({{'lines': [o_orderpriority, o_orderstatus], 'note': NULL, 'owner': o_custkey, 'total': o_totalprice}}) AS VARCHAR) AS payload FROM orders)
SELECT o_orderkey, payload, sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(strftime(issued, '%Y%m%d%H%M%S') || '.' || payload)))) AS seal, o_orderkey % 3 <> 0 AS opens, false AS changed_opens FROM p""",
    "worst_health_by_host": f"""WITH {TERMS_SQL}, x AS (SELECT host, s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 7 <> 0 THEN {list(STATES)}[(s_suppkey // 40) % 4 + 1] END AS status FROM supplier JOIN terms ON supplier_id = s_suppkey),
y AS (SELECT *, CASE WHEN status IS NULL THEN 1 WHEN status = 'error' THEN 4 WHEN status = 'ignores_query' THEN 3 WHEN status = 'empty' THEN 2 ELSE 0 END AS severity FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY severity DESC, s_suppkey) AS nth FROM y), n AS (SELECT host, count(DISTINCT s_nationkey) AS accounts FROM x GROUP BY 1)
SELECT z.host, status, s_name AS detail, severity, accounts FROM z JOIN n ON n.host = z.host WHERE nth = 1""",
    "client_search": f"""WITH {LISTINGS_SQL}, {TERMS_SQL} SELECT product_id, competitor_id FROM listings JOIN part ON p_partkey = product_id JOIN terms ON supplier_id = competitor_id
WHERE contains(lower(concat_ws(' ', p_name, p_brand, supplier_name, host, 'W' || p_size, p_type)), 'w4')""",
    "newest_filled_answer": """WITH x AS (SELECT user_id, event_id, ts, CAST(props->>'$.k' AS INTEGER) % 4 AS n_elements FROM events),
y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM x WHERE n_elements > 0) SELECT user_id, event_id, n_elements FROM y WHERE nth = 1""",
    "confidence_order": f"""WITH {LISTINGS_SQL}, k AS (SELECT *, product_id * 7 + competitor_id * 13 AS k FROM listings),
x AS (SELECT *, {list(RELATIONS)}[k % 6 + 1] AS relation, CASE WHEN k % 11 <> 0 THEN CAST(k % 100 AS DOUBLE) / 100 END AS c FROM k)
SELECT product_id, competitor_id, {_PLACE("floor(c * 10) DESC NULLS LAST, price NULLS LAST, competitor_id")},
  CASE WHEN relation IN ('conflict', 'unrelated') THEN 'excluded' WHEN relation = 'same_product' AND c >= 0.85 THEN 'strong' WHEN relation IN ('same_product', 'compatible') THEN 'possible' ELSE 'similar' END AS answer_group FROM x""",
    "listing_order": f"""WITH {LISTINGS_SQL} SELECT product_id, competitor_id, {_PLACE("(product_id + competitor_id) % 9 = 0 DESC, price NULLS LAST, s_name, competitor_id")} FROM listings JOIN supplier ON s_suppkey = competitor_id""",
    "coverage_order": f"""WITH {_COVER_SQL}, x AS (SELECT supplier_id, {_PLACE("covered DESC, total NULLS LAST, supplier_id", "order_id")} FROM cover) SELECT supplier_id, place, count(*) AS n FROM x GROUP BY 1, 2""",
    "query_spellings": """WITH x AS (SELECT p_partkey, p_name || ' ' || p_size || ['х', ' x ', ' по '][p_partkey % 3 + 1] || '2' || CASE WHEN p_partkey % 2 = 0 THEN ',' ELSE '.' END || '5' AS respelled, upper(substr(p_name, 1, 3)) AS a, CAST(p_size AS VARCHAR) AS b FROM part)
SELECT p_partkey, respelled, CASE p_partkey % 3 WHEN 0 THEN a || '-' || b || '|' || a || ' ' || b || '|' || a || b WHEN 1 THEN a || ' / ' || b || '|' || a || ' ' || b || '|' || a || b ELSE a || b END AS codes FROM x""",
    "names_from_urls": """WITH x AS (SELECT page_id, url, list_filter(string_split(url_decode(regexp_replace(url, '^[a-z]+://[^/?#]*|[?#].*$', '', 'g')), '/'), lambda p: p <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'kabel svt do 1 mm2' ELSE coalesce(nullif(trim(regexp_replace(parts[-1], '[-_]+', ' ', 'g')), ''), url) END AS name FROM x""",
    "word_stems": """WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM benchmark),
a AS (SELECT word, CASE WHEN length(word) > 4 AND word LIKE '%ies' THEN word[:-4] || 'y' WHEN length(word) > 4 AND regexp_matches(word, '(ses|xes|ches|shes)$') THEN word[:-3] END AS early FROM w WHERE word <> ''),
b AS (SELECT *, CASE WHEN length(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN word[:-2] ELSE word END AS x FROM a),
c AS (SELECT *, CASE WHEN length(x) > 4 AND regexp_matches(x, '(ove|ata|ite|ове)$') THEN x[:-4] ELSE x END AS y FROM b)
SELECT word, coalesce(early, CASE WHEN length(y) > 3 AND regexp_matches(y, '[иаяе]$') THEN y[:-2] ELSE y END) AS stem FROM c""",
    "page_price_ladder": """SELECT page_id, CASE WHEN page_id % 5 < 4 THEN CAST(page_id % 900 + 100 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS price, ['json_ld', 'microdata', 'meta', 'microdata', NULL][page_id % 5 + 1] AS strategy FROM pages""",
    "sitemap_addresses": "SELECT page_id, url FROM pages UNION ALL SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/b' FROM pages",
    "sql_surface": f"""WITH {LISTINGS_SQL}, {TERMS_SQL} SELECT p_brand AS brand, count(*) AS listings, count(DISTINCT host) AS hosts, max({sql_money("price * CAST(1.1 AS DOUBLE)")}) AS dearest,
  max(regexp_replace(lower(supplier_name), '[^a-z0-9]', '', 'g')) AS last_code, min(CASE WHEN vat_state = 'inclusive' THEN {sql_money("price / (1 + vat_rate / 100)")} ELSE price END) AS cheapest_net,
  max({sql_money("(price - p_retailprice) / p_retailprice * 100")}) AS largest_change FROM listings JOIN part ON p_partkey = product_id JOIN terms ON supplier_id = competitor_id WHERE p_retailprice >= 905 GROUP BY 1""",
    "sql_request_rows": "SELECT p_partkey, unnest([0, 1, 2]) AS line, unnest([p_name, p_type, p_brand]) AS query FROM part",
}
