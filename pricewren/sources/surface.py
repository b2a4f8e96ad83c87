"""The engine in SQL: tables and entities as views, scalar rules as SQL functions that Spark inlines into the plan, a table function for requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewren.sources import tables

ENTITIES = {"products": tables.products, "listings": tables.listings, "price_history": tables.price_history, "supplier_terms": tables.supplier_terms, "decisions": tables.decisions, "order_suppliers": tables.order_suppliers}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Functions by name with parameters and body. The bodies are expressions, so filters and pruning pass through them.
FUNCTIONS = {
    "money_round": ("x DOUBLE", "DOUBLE", "floor((x + 2.220446049250313e-16D) * 100 + 0.5D) / 100"),
    "change_percent": ("old DOUBLE, new DOUBLE", "DOUBLE", "CASE WHEN old <> 0 THEN floor(((new - old) / old * 100 + 2.220446049250313e-16D) * 100 + 0.5D) / 100 END"),
    "net_price": ("price DOUBLE, state STRING, rate DOUBLE", "DOUBLE", "CASE WHEN state = 'inclusive' AND rate > 0 THEN floor((price / (1 + rate / 100) + 2.220446049250313e-16D) * 100 + 0.5D) / 100 ELSE price END"),
    "host_of": ("url STRING", "STRING", r"nullif(regexp_extract(lower(trim(url)), '^https?://(?:www\\.)?([^/?#:]+)', 1), '')"),
    "canonical_identifier": ("x STRING", "STRING", "regexp_replace(lower(translate(x, 'аеорсухкмтвнАЕОРСУХКМТВН', 'aeopcyxkmtbhAEOPCYXKMTBH')), '[^a-z0-9]', '')"),
    "confidence_band": ("c DOUBLE", "STRING", "CASE WHEN c >= 0.95D THEN 'certain' WHEN c >= 0.85D THEN 'high' WHEN c >= 0.70D THEN 'possible' ELSE 'weak' END"),
}
#: A request's lines as rows, in order.
REQUEST_LINES = r"""CREATE OR REPLACE TEMPORARY FUNCTION request_rows(request STRING) RETURNS TABLE(line INT, query STRING)
RETURN SELECT pos, trim(col) FROM posexplode(filter(split(request, '[;\n\r]+'), x -> trim(x) <> '')) WHERE pos < 60"""


def register(spark: SparkSession) -> None:
    """Temporary functions of this session: FUNCTIONS, and request_rows(request) for a FROM clause."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.sql(REQUEST_LINES)


def views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of tables and entities of a folder."""
    for name in TABLES:
        tables.table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, make in ENTITIES.items():
        make(spark, sf_dir).createOrReplaceTempView(name)


def query(spark: SparkSession, sf_dir: str, text: str, **args: object) -> DataFrame:
    """A query in SQL over views and functions; values of its :names come as arguments, never as text."""
    register(spark)
    views(spark, sf_dir)
    return spark.sql(text, args=args)
