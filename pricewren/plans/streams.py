"""Queries that run as streams over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions.money import money_round
from pricewren.operators import series
from pricewren.sources.tables import sql_money, table
from pricewren.streaming import alerts, observations, outbox, windows

#: Failures in a row and minutes of cooldown that the made observations reach.
FEW, MINUTES = 3, 3 * 1440


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.events_stream(spark, f"{sf_dir}/event[s].parquet")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.materialised(windows.tumbling(_events(spark, sf_dir), "1 day", "event_type"), spark, "tumbling", "update", ("start", "event_type"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.materialised(windows.tumbling(_events(spark, sf_dir), "2 days", slide="1 day"), spark, "sliding", "update", ("start",))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished sessions: those that end more than an hour before the latest event."""
    return windows.materialised(windows.sessions(_events(spark, sf_dir), "6 hours", "user_id"), spark, "session")


def stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.first_claims(_events(spark, sf_dir), ["event_id"]).select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return windows.materialised(rows, spark, "claims")


def stream_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.materialised(observations.alerts(_events(spark, sf_dir)), spark, "observations")


def _observed(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: users as listings of twenty products, errors as failed checks, stock by a property, and targets from the parts."""
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 4 != 0, money_round(F.col("p_retailprice") / 100)).alias("target_price"))
    in_stock = F.get_json_object("props", "$.k").cast("int") % 10 != 0
    made = rows.select((F.col("user_id") % 20).alias("product_id"), F.col("user_id").alias("competitor_id"), "event_id", "ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("price"), in_stock.alias("in_stock"))
    return made.join(targets, "product_id", "left")


def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of alerts, by windows over the whole log."""
    return series.observed_alerts(_observed(table(spark, sf_dir, "events"), spark, sf_dir), FEW, minutes=MINUTES)


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alerts by keyed state and timers, of what is older than the watermark (an hour before the latest event)."""
    with windows.settings(spark, alerts.ROCKSDB):
        return windows.materialised(alerts.raised(_observed(_events(spark, sf_dir), spark, sf_dir), FEW, minutes=MINUTES), spark, "alerts")


#: Keys of an alert, and channels that fail by its number: chat at times in the first attempt alone.
ALERT = ("product_id", "competitor_id", "event_id", "type")
CHANNELS = {
    "chat": lambda rows: ["refused" if e % 3 == 0 else "busy" if e % 7 == 0 and n == 0 else None for e, n in zip(rows["event_id"], rows["attempt"])],
    "hook": lambda rows: ["timeout" if e % 5 == 0 else None for e in rows["event_id"]],
}


def stream_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's alerts through an outbox to two channels, with one retry of what failed."""
    folder, progress = windows.shared_folder(spark, "outbox"), windows.shared_folder(spark, "outbox-progress")
    with windows.settings(spark, alerts.ROCKSDB):
        outbox.deliver(alerts.raised(_observed(_events(spark, sf_dir), spark, sf_dir), FEW, minutes=MINUTES), folder, progress, ALERT, CHANNELS)
    outbox.retry(spark, folder, alerts.ALERTS, ALERT, CHANNELS, 1)
    return outbox.status(spark, folder, alerts.ALERTS, ALERT, CHANNELS).select(*ALERT, "severity", "delivery_status", "delivered_channels", "delivery_error")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_claims, stream_observations, alert_feed, stream_alerts, stream_delivery)}

_TOTAL = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"

_DUE = "WHERE epoch_us(ts) <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events)"


def _alerts_sql(which: str) -> str:
    severities = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in series.SEVERITY.items())
    listing = "PARTITION BY product_id, competitor_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""WITH RECURSIVE o AS (SELECT user_id % 20 AS product_id, user_id AS competitor_id, event_id, ts, event_type <> 'error' AND value IS NOT NULL AS ok,
  CASE WHEN event_type <> 'error' THEN value END AS price, CAST(props ->> '$.k' AS INT) % 10 <> 0 AS in_stock, CASE WHEN p_partkey % 4 <> 0 THEN {sql_money("p_retailprice / 100")} END AS target
  FROM events LEFT JOIN part ON p_partkey = user_id % 20 {which}),
a AS (SELECT *, last_value(price IGNORE NULLS) OVER ({listing} 1 PRECEDING) AS known, count(*) FILTER (WHERE ok) OVER ({listing} CURRENT ROW) AS island FROM o),
b AS (SELECT *, last_value(CASE WHEN ok THEN {{'p': price, 'k': known}} END IGNORE NULLS) OVER ({listing} 1 PRECEDING) AS pair,
  count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY product_id, competitor_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM a),
c AS (SELECT *, max(streak) OVER ({listing} CURRENT ROW) < {FEW} AS active FROM b),
d AS (SELECT *, min(price) FILTER (WHERE active) OVER (PARTITION BY product_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest,
  CASE WHEN known <> 0 THEN {sql_money("(price - known) / known * 100", 4)} END AS change_pct FROM c),
x AS (SELECT *, CASE WHEN ok THEN known ELSE pair.k END AS old_price, CASE WHEN ok THEN price ELSE pair.p END AS new_price FROM d),
f AS MATERIALIZED (SELECT *, 'undercut' AS type FROM x WHERE ok AND price < target UNION ALL SELECT *, 'price_drop' FROM x WHERE change_pct <= -5 UNION ALL SELECT *, 'price_rise' FROM x WHERE change_pct >= 5
  UNION ALL SELECT *, 'all_time_low' FROM x WHERE active AND price < lowest UNION ALL SELECT *, 'out_of_stock' FROM x WHERE ok AND NOT in_stock UNION ALL SELECT *, 'scrape_failing' FROM x WHERE NOT ok AND streak >= {FEW}),
n AS MATERIALIZED (SELECT p.competitor_id, p.type, p.event_id, first(q.event_id ORDER BY q.ts, q.event_id) AS following FROM f AS p JOIN f AS q ON p.competitor_id = q.competitor_id AND p.type = q.type
  AND q.ts >= p.ts + INTERVAL {MINUTES} MINUTE GROUP BY ALL),
r AS (SELECT competitor_id, type, first(event_id ORDER BY ts, event_id) AS event_id FROM f GROUP BY ALL
  UNION ALL SELECT r.competitor_id, r.type, n.following FROM r JOIN n ON n.competitor_id = r.competitor_id AND n.type = r.type AND n.event_id = r.event_id),
raised AS (SELECT product_id, competitor_id, event_id, type, CASE type {severities} END AS severity, old_price, new_price, change_pct FROM f JOIN r USING (competitor_id, type, event_id))"""


ORACLES = {
    "alert_feed": f"{_alerts_sql('')} SELECT * FROM raised",
    "stream_alerts": f"{_alerts_sql(_DUE)} SELECT * FROM raised",
    "stream_delivery": f"""{_alerts_sql(_DUE)},
z AS (SELECT *, event_id % 3 <> 0 AS chat, event_id % 5 <> 0 AS hook FROM raised)
SELECT product_id, competitor_id, event_id, type, severity, CASE WHEN chat OR hook THEN 'delivered' ELSE 'failed' END AS delivery_status,
  nullif(concat_ws(',', CASE WHEN chat THEN 'chat' END, CASE WHEN hook THEN 'hook' END), '') AS delivered_channels,
  nullif(concat_ws('; ', CASE WHEN NOT chat THEN 'chat: refused' END, CASE WHEN NOT hook THEN 'hook: timeout' END), '') AS delivery_error FROM z""",
    "stream_tumbling": f"""SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, {_TOTAL} AS total FROM events GROUP BY 1, 2, 3""",
    "stream_sliding": f"""SELECT s AS start, s + INTERVAL 2 DAY AS "end", count(*) AS n, {_TOTAL} AS total
FROM events, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS x(s) GROUP BY 1, 2""",
    "stream_session": """WITH a AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM a),
c AS (SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, island)
SELECT start, "end", user_id, n FROM c WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_claims": "SELECT DISTINCT event_id, user_id, ts FROM events",
}
