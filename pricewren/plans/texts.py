"""Queries over names and texts: normal forms, identifiers, amounts, requests, units, joins of similar names, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions import amounts, requests, text, units
from pricewren.operators import relations, textjoin
from pricewren.sources.tables import table

_PUNCTUATION = "[\"'`«»„“”‘’()\\[\\]{}.,;:!?/|+\\\\]"


def _digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = text.normalise_text(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", x.alias("normal"), F.size(text.tokens(x)).cast("long").alias("n_tokens"))


def fold_homoglyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _digest(text.fold_homoglyphs(F.col("text"))).alias("digest"))


def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_identifier(F.concat("p_brand", F.lit(" / "), "p_name")).alias("code"))


def sha_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.fingerprint(F.col("p_name"), F.col("p_brand"), F.lit("v1")).alias("fingerprint"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names with their brand; the id is the name itself."""
    return table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_brand").alias("name")).distinct().withColumn("id", F.col("name"))


def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjoin.similar_names(names(spark, sf_dir))


def contains_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.contains_all(text.query_words(F.lit("Red, RING")), text.normalise_text(F.col("p_name")))
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.bool_and(found).alias("found"))


def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad((F.col("p_partkey") * 7919 + 13).cast("string"), 13, "0")
    return table(spark, sf_dir, "part").select("p_partkey", digits.alias("digits"), text.gtin_valid(digits).alias("valid"))


def _amount_text() -> Column:
    """Prices as they are written in several ways."""
    k, price = F.col("l_linenumber"), F.col("l_extendedprice")
    whole, cents = F.floor(price).cast("long"), F.floor(price * 100 + 0.5).cast("long") % 100
    thousands, rest, c = F.floor(whole / 1000).cast("string"), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lpad(cents.cast("string"), 2, "0")
    return (
        F.when(k == 1, F.concat(thousands, F.lit("."), rest, F.lit(","), c, F.lit(" лв.")))
        .when(k == 2, F.concat(thousands, F.lit(","), rest, F.lit("."), c, F.lit(" USD")))
        .when(k == 3, F.concat(F.lit("€"), whole.cast("string"), F.lit("."), c))
        .when(k == 4, F.concat(thousands, F.lit("."), rest))
        .when(k == 5, F.concat(whole.cast("string"), F.lit(","), c, F.lit(" lei")))
        .otherwise(F.lit("по запитване"))
    )


def _amount_rows(spark: SparkSession, sf_dir: str, parse, **more) -> DataFrame:
    raw = _amount_text()
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), parse(raw).alias("amount"), *[f(raw).alias(k) for k, f in more.items()])


def parse_amount_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amount_rows(spark, sf_dir, amounts.parse_amount_web, currency=amounts.detect_currency)


def parse_amount_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amount_rows(spark, sf_dir, amounts.parse_amount_list)


def parse_request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of two lines made from products: a quantity behind a comma, and one in front."""
    size = F.col("p_size").cast("string")
    written = F.concat(F.col("p_name"), F.lit(", "), size, F.lit(" pcs; ; "), size, F.lit(" x "), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(requests.request_lines(written)).alias("line", "r"))
    return rows.select("p_partkey", F.col("line").cast("long").alias("line"), "r.query", "r.quantity", "r.unit")


def availability_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = ("Now IN STOCK!", "Sold out, not in stock", "disponibil", "ask us", "Indisponibil")
    said = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("p_size") % len(phrases) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("said"), requests.availability(said).alias("in_stock"))


_UNITS = ("mm", "cm", "m", "inch", "g", "kg")


def _unit(at: int) -> Column:
    return F.element_at(F.array(*[F.lit(u) for u in _UNITS]), ((F.col("p_size") + at) % len(_UNITS) + 1).cast("int"))


def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("p_size").cast("double")
    out = units.convert_unit(value, _unit(0), _unit(1))
    return table(spark, sf_dir, "part").select("p_partkey", _unit(0).alias("unit"), _unit(1).alias("target"), (F.floor(out * 1e6 + 0.5).cast("double") / 1e6).alias("converted"))


def same_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = units.to_base(F.col("p_size").cast("double"), F.lit("cm")), units.to_base(F.col("p_retailprice") / 100, F.lit("m"))
    return table(spark, sf_dir, "part").select("p_partkey", units.same_quantity(a * 100, b).alias("same"))


def spell_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of product names against the same ones with one letter too few, too many or swapped."""
    known = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    n = F.char_length("word")
    swapped = F.concat(F.substring("word", 1, 1), F.substring("word", 3, 1), F.substring("word", 2, 1), F.substring(F.col("word"), F.lit(4), n))
    wrong = known.select(F.explode(F.array(swapped, F.concat("word", F.lit("z")), F.substring(F.col("word"), F.lit(2), n), F.concat(F.lit("q"), F.substring(F.col("word"), F.lit(2), n)))).alias("word"))
    return textjoin.corrections(wrong, known)


def manual_price_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_name").distinct()
    return textjoin.price_search(rows.withColumnRenamed("p_name", "query"), rows.withColumnRenamed("p_name", "name"))


def sitemap_slug_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.query_words(text.transliterate(F.lit("fr page")))
    slug = text.slug_of(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", slug.alias("slug"), text.contains_all(words, slug).alias("page"), F.contains(slug, F.lit("en")).alias("en"))


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under rules of their host: some language folders are closed, single pages in them open."""
    pages = table(spark, sf_dir, "pages").select("page_id", text.host_of(F.col("url")).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    hosts = pages.select("host").distinct()
    rule = lambda prefix, allow: F.struct(F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow"))
    rules = hosts.select("host", F.explode(F.array(rule("/fr", False), rule("/fr/8", True), rule("/en/2", False), rule("/en/2", True), rule("", False))).alias("r")).select("host", "r.*")
    return textjoin.robots_allowed(pages, rules).select("page_id", "path", "allowed")


def page_title_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


def per_domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three pages of each host in order of arrival."""
    rows = table(spark, sf_dir, "pages").select("page_id", text.host_of(F.col("url")).alias("host"))
    return relations.first_n(rows, ["host"], ["page_id"], 3).select("page_id", "host", "nth")


QUERIES = {
    f.__name__: f
    for f in (
        normalise_text, fold_homoglyphs, canonical_id, sha_fingerprint, similarity_join, contains_all_tokens, gtin_check, parse_amount_web, parse_amount_list,
        parse_request_lines, availability_flag, unit_convert, same_quantity, spell_correction, manual_price_search, sitemap_slug_search, robots_rules, page_title_and_links,
        per_domain_cap,
    )
}

_P = "[\"''`«»„“”‘’()\\[\\]{}.,;:!?/|+\\\\]"


def sql_normal(x: str) -> str:
    """normalise_text for texts without borrowed words."""
    folded = f"lower(translate(lower({x}), '{text.LOOK_ALIKE}', '{text.LATIN}'))"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({folded}, '{_P}', ' ', 'g'), '[‐‑‒–—―−]', '-', 'g'), '[\\s\\x0B]+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    return f"list_distinct(list_filter(string_split_regex({x}, '[\\s-]+'), lambda t: length(t) >= 2 AND NOT list_contains([{stop}], t)))"


_W = "list_sum(list_transform({}, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN CAST(2.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END))"
_RAW = """CASE l_linenumber WHEN 1 THEN CAST(w // 1000 AS VARCHAR) || '.' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') || ',' || c || ' лв.'
  WHEN 2 THEN CAST(w // 1000 AS VARCHAR) || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') || '.' || c || ' USD' WHEN 3 THEN '€' || CAST(w AS VARCHAR) || '.' || c
  WHEN 4 THEN CAST(w // 1000 AS VARCHAR) || '.' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') WHEN 5 THEN CAST(w AS VARCHAR) || ',' || c || ' lei' ELSE 'по запитване' END"""
_RAW_SQL = f"""WITH x AS (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS w, CAST(floor(l_extendedprice * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) % 100 AS c1 FROM lineitem),
y AS (SELECT *, lpad(CAST(c1 AS VARCHAR), 2, '0') AS c FROM x), z AS (SELECT *, {_RAW} AS raw, CAST(w AS DOUBLE) + CAST(c1 AS DOUBLE) / 100 AS both FROM y)"""
_WRITTEN = "CAST(CAST(w AS VARCHAR) || '.' || c AS DOUBLE)"
_FACTOR = "CASE {} WHEN 'mm' THEN CAST(0.001 AS DOUBLE) WHEN 'cm' THEN CAST(0.01 AS DOUBLE) WHEN 'm' THEN CAST(1 AS DOUBLE) WHEN 'inch' THEN CAST(0.0254 AS DOUBLE) WHEN 'g' THEN CAST(0.001 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
_UNIT = "['mm', 'cm', 'm', 'inch', 'g', 'kg'][(p_size + {}) % 6 + 1]"
_SLUG = "regexp_replace(lower(url_decode(regexp_replace(url, '^[a-z]+://[^/?#]*|[?#].*$', '', 'g'))), '[^a-z0-9]', '', 'g')"
_HOST = "nullif(regexp_extract(lower(trim(url)), '^https?://(?:www\\.)?([^/?#:]+)', 1), '')"

ORACLES = {
    "normalise_text": f"WITH x AS (SELECT item_id, {sql_normal('text')} AS normal FROM benchmark) SELECT item_id, normal, len({sql_tokens('normal')}) AS n_tokens FROM x",
    "fold_homoglyphs": f"SELECT doc_id, sha256(translate(text, '{text.LOOK_ALIKE}', '{text.LATIN}')) AS digest FROM documents",
    "canonical_id": "SELECT p_partkey, regexp_replace(lower(p_brand || p_name), '[^a-z0-9]', '', 'g') AS code FROM part",
    "sha_fingerprint": "SELECT p_partkey, sha256(p_name || '|' || p_brand || '|v1') AS fingerprint FROM part",
    "similarity_join": f"""WITH n AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part), t AS (SELECT name, {sql_tokens(sql_normal('name'))} AS t FROM n),
p AS (SELECT a.name AS a, b.name AS b, list_intersect(a.t, b.t) AS i, list_distinct(list_concat(a.t, b.t)) AS u FROM t AS a JOIN t AS b ON a.name < b.name),
s AS (SELECT a, b, CAST(floor(coalesce({_W.format('i')}, 0) / {_W.format('u')} * 1000 + CAST(0.5 AS DOUBLE)) AS DOUBLE) / 1000 AS similarity FROM p)
SELECT * FROM s WHERE similarity >= 0.6""",
    "contains_all_tokens": "SELECT p_name, count(*) AS n, p_name LIKE '%red%' AND p_name LIKE '%ring%' AS found FROM part GROUP BY p_name",
    "gtin_check": """WITH x AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 13 AS VARCHAR), 13, '0') AS digits FROM part)
SELECT p_partkey, digits, list_sum(list_transform(range(1, 14), lambda i: CAST(substr(digits, i, 1) AS INTEGER) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))) % 10 = 0 AS valid FROM x""",
    "parse_amount_web": f"""{_RAW_SQL} SELECT l_orderkey, l_linenumber, raw, CASE WHEN l_linenumber IN (1, 2, 3, 5) THEN nullif({_WRITTEN}, 0) WHEN l_linenumber = 4 THEN nullif(CAST(w AS DOUBLE), 0) END AS amount,
  CASE l_linenumber WHEN 1 THEN 'BGN' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' WHEN 5 THEN 'RON' END AS currency FROM z""",
    "parse_amount_list": f"""{_RAW_SQL} SELECT l_orderkey, l_linenumber, raw, CASE WHEN l_linenumber IN (1, 2, 3) THEN {_WRITTEN} WHEN l_linenumber = 4 THEN CAST(w AS DOUBLE) END AS amount FROM z""",
    "parse_request_lines": """SELECT p_partkey, CAST(0 AS BIGINT) AS line, p_name AS query, CAST(p_size AS DOUBLE) AS quantity, 'pcs' AS unit FROM part WHERE p_size > 0
UNION ALL SELECT p_partkey, 1, p_brand, CAST(p_size AS DOUBLE), NULL FROM part WHERE p_size > 0""",
    "availability_flag": """WITH x AS (SELECT p_partkey, ['Now IN STOCK!', 'Sold out, not in stock', 'disponibil', 'ask us', 'Indisponibil'][p_size % 5 + 1] AS said FROM part)
SELECT p_partkey, said, CASE WHEN regexp_matches(said, '(?i)(sold out|out of stock|indisponibil)') THEN false WHEN regexp_matches(said, '(?i)(in stock|disponibil)') THEN true END AS in_stock FROM x""",
    "unit_convert": f"""WITH x AS (SELECT p_partkey, p_size, {_UNIT.format(0)} AS unit, {_UNIT.format(1)} AS target FROM part)
SELECT p_partkey, unit, target, CASE WHEN (unit IN ('g', 'kg')) = (target IN ('g', 'kg'))
  THEN CAST(floor(CAST(p_size AS DOUBLE) * {_FACTOR.format('unit')} / {_FACTOR.format('target')} * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS DOUBLE) / CAST(1e6 AS DOUBLE) END AS converted FROM x""",
    "same_quantity": """WITH x AS (SELECT p_partkey, floor(CAST(p_size AS DOUBLE) * CAST(0.01 AS DOUBLE) * CAST(1e9 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e9 AS DOUBLE) * 100 AS a,
  floor(p_retailprice / 100 * CAST(1e9 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e9 AS DOUBLE) AS b FROM part)
SELECT p_partkey, abs(a - b) <= CAST(0.001 AS DOUBLE) * greatest(abs(a), abs(b)) AS same FROM x""",
    "spell_correction": """WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS known FROM part),
w AS (SELECT DISTINCT unnest([substr(known, 1, 1) || substr(known, 3, 1) || substr(known, 2, 1) || substr(known, 4), known || 'z', substr(known, 2), 'q' || substr(known, 2)]) AS word FROM k)
SELECT word, known FROM w, k WHERE length(word) >= 5 AND length(known) >= 5 AND word NOT IN (SELECT known FROM k) AND damerau_levenshtein(word, known) = 1""",
    "manual_price_search": f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, unnest({sql_tokens("name")}) AS token FROM n),
s AS (SELECT a.name AS query, b.name, count(*) AS shared FROM t AS a JOIN t AS b ON a.token = b.token GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, name) AS rank FROM s) SELECT * FROM r WHERE rank <= 8""",
    "sitemap_slug_search": f"SELECT page_id, {_SLUG} AS slug, contains({_SLUG}, 'page') AS page, contains({_SLUG}, 'en') AS en FROM pages",
    "robots_rules": """WITH x AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, CASE WHEN starts_with(path, '/fr/8') THEN true WHEN starts_with(path, '/fr') THEN false ELSE true END AS allowed FROM x""",
    "page_title_and_links": """SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages""",
    "per_domain_cap": f"""WITH x AS (SELECT page_id, {_HOST} AS host FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS nth FROM x) SELECT * FROM r WHERE nth <= 3""",
}
