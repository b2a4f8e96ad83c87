"""Queries over the event log: failures, daily series, latencies, streaks, claims, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions.money import exact_avg, exact_sum, money_round, plain_round
from pricewren.functions.text import host_of
from pricewren.operators import relations, reports, series
from pricewren.sources.tables import sql_money, sql_plain, table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNKNOWN"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def failures_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the host whose page has the user's number: checks, failures and the latest error that is not null; worst 50 first."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), host_of(F.col("url")).alias("host"))
    failed = F.col("event_type") == "error"
    rows = events(spark, sf_dir).join(pages, "user_id").groupBy("host").agg(
        F.count("*").alias("checks"), F.count_if(failed).alias("failures"), F.max(F.when(failed, F.struct("ts", "event_id", "props"))).getField("props").alias("latest_error")
    )
    return rows.where("failures > 0").orderBy(F.desc("failures"), "host").limit(50)


def json_props_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).where(k >= 90).select("event_id", k.alias("k"), F.get_json_object("props", "$.missing").isNull().alias("no_other"))


def daily_series_gapfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'purchase'")
    return series.gap_filled_days(rows, "ts", {"n": F.count("*"), "total": exact_sum(F.col("value"))})


def daily_received_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("event_type") != "error"
    rows = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return rows.agg(F.count("*").alias("received"), F.count_if(good).alias("processed"), reports.share(F.count_if(good), F.count("*")).alias("share"))


def enum_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.zero_filled(table(spark, sf_dir, "customer"), "c_mktsegment", SEGMENTS)


def latency_p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.count("*").alias("n"))


def latency_p95_floor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.p95_floor_index(events(spark, sf_dir), ["event_type"], "value")


def rolling_last_n_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the newest 200 events."""
    newest = reports.last_n(events(spark, sf_dir), [F.desc("ts"), F.desc("event_id")], 200)
    failed = F.count_if(F.col("event_type") == "error")
    return newest.agg(
        F.count("*").alias("runs"), money_round(exact_avg(F.col("value"))).alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"),
        F.max("value").alias("most"), failed.alias("failed"), reports.share(failed, F.count("*")).alias("failed_share"),
    )


def merge_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a user's events as one: good if any is, the longest duration, the first one's properties."""
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("answers"), F.bool_or(F.col("event_type") != "error").alias("ok"), F.max("value").alias("duration"), F.min_by("props", F.struct("ts", "event_id")).alias("props")
    )


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_streaks(events(spark, sf_dir), "user_id", F.col("event_type") == "error", ["ts", "event_id"], 3)


def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, type and properties claims them."""
    return events(spark, sf_dir).groupBy("user_id", "event_type", "props").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), (F.count("*") - 1).alias("repeats"))


def run_count_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.struct("ts", "event_id")
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("run_count"), F.max_by("value", last).alias("last_value"), F.max("ts").alias("last_run_at"))


def daily_budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.admitted(events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["user_id", "day"], ["ts", "event_id"], 2)
    return rows.groupBy("day").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


def set_equality_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error").withColumn("url", F.when(F.col("ok"), (F.col("event_id") % (1 + F.col("user_id") % 3)).cast("string")))
    health = reports.answer_health(rows.withColumn("query", F.col("event_id") % 2), "ok", "user_id", "query", "url")
    return health.select("user_id", "health", "probes")


def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user: share of successes in percent with one decimal; views are pending and count on neither side."""
    good, bad = F.count_if(F.col("event_type").isin("click", "purchase", "signup")), F.count_if(F.col("event_type") == "error")
    return events(spark, sf_dir).groupBy("user_id").agg(F.when(good + bad > 0, plain_round(good / (good + bad) * 100, 1)).alias("rate"))


def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'error'")
    return series.cooled_down(rows, ("user_id",), "ts", "event_id", minutes=3 * 1440)


def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.first_n(events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 2)
    return rows.select("user_id", "event_id", "event_type", "nth")


QUERIES = {
    f.__name__: f
    for f in (
        failures_by_host, json_props_projection, daily_series_gapfilled, daily_received_processed, enum_zero_filled, latency_p95_nearest_rank, latency_p95_floor_index,
        rolling_last_n_stats, merge_by_host, failure_streaks, event_dedup, run_count_upsert, daily_budget_admission, set_equality_health, success_rate, alert_cooldown,
        latest_event_per_user,
    )
}

_dsum = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
_rate = "CAST(good AS DOUBLE) / (good + bad) * 100"

ORACLES = {
    "failures_by_host": """WITH p AS (SELECT page_id, nullif(regexp_extract(lower(trim(url)), '^https?://(?:www\\.)?([^/?#:]+)', 1), '') AS host FROM pages)
SELECT host, count(*) AS checks, count(*) FILTER (WHERE event_type = 'error') AS failures, first(props ORDER BY ts DESC, event_id DESC) FILTER (WHERE event_type = 'error') AS latest_error
FROM events JOIN p ON page_id = user_id GROUP BY host HAVING count(*) FILTER (WHERE event_type = 'error') > 0 ORDER BY failures DESC, host LIMIT 50""",
    "json_props_projection": "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, (props ->> '$.missing') IS NULL AS no_other FROM events WHERE CAST(props ->> '$.k' AS BIGINT) >= 90",
    "daily_series_gapfilled": f"""WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, {_dsum("value")} AS total FROM events WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d)
SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM s LEFT JOIN d ON d.day = s.day""",
    "daily_received_processed": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS received, count(*) FILTER (WHERE event_type <> 'error') AS processed,
  {sql_plain("CAST(count(*) FILTER (WHERE event_type <> 'error') AS DOUBLE) / count(*)", 3)} AS share FROM events GROUP BY 1""",
    "enum_zero_filled": f"""SELECT s.c_mktsegment, (SELECT count(*) FROM customer AS c WHERE c.c_mktsegment = s.c_mktsegment) AS n
FROM (VALUES {", ".join(f"('{s}')" for s in SEGMENTS)}) AS s(c_mktsegment)""",
    "latency_p95_nearest_rank": "SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, count(*) AS n FROM events GROUP BY 1",
    "latency_p95_floor_index": """WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[least(len(v), CAST(floor(len(v) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1)] AS p95 FROM l""",
    "rolling_last_n_stats": f"""WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)
SELECT count(*) AS runs, {sql_money(_dsum("value") + " / count(value)")} AS mean, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS most,
  count(*) FILTER (WHERE event_type = 'error') AS failed, {sql_plain("CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*)", 3)} AS failed_share FROM n""",
    "merge_by_host": "SELECT user_id, count(*) AS answers, bool_or(event_type <> 'error') AS ok, max(value) AS duration, first(props ORDER BY ts, event_id) AS props FROM events GROUP BY 1",
    "failure_streaks": """WITH x AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
  - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, count(*) AS failures, min(ts) AS since, max(ts) AS until FROM x WHERE event_type = 'error' GROUP BY user_id, island HAVING count(*) >= 3""",
    "event_dedup": "SELECT user_id, event_type, props, first(event_id ORDER BY ts, event_id) AS event_id, count(*) - 1 AS repeats FROM events GROUP BY 1, 2, 3",
    "run_count_upsert": "SELECT user_id, event_type, count(*) AS run_count, last(value ORDER BY ts, event_id) AS last_value, max(ts) AS last_run_at FROM events GROUP BY 1, 2",
    "daily_budget_admission": """WITH x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS nth FROM events)
SELECT day, count(*) FILTER (WHERE nth <= 2) AS admitted, count(*) FILTER (WHERE nth > 2) AS refused FROM x GROUP BY day""",
    "set_equality_health": """WITH x AS (SELECT user_id, event_id % 2 AS query, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN event_id % (1 + user_id % 3) END AS url FROM events),
s AS (SELECT user_id, query, bool_or(ok) AS ok, count(DISTINCT url) AS n, coalesce(string_agg(DISTINCT CAST(url AS VARCHAR), ',' ORDER BY CAST(url AS VARCHAR)), '') AS urls FROM x GROUP BY 1, 2)
SELECT user_id, CASE WHEN NOT bool_or(ok) THEN 'error' WHEN max(n) = 0 THEN 'empty' WHEN count(*) > 1 AND count(DISTINCT urls) = 1 THEN 'ignores_query' ELSE 'ok' END AS health, count(*) AS probes FROM s GROUP BY 1""",
    "success_rate": f"""WITH x AS (SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'signup')) AS good, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)
SELECT user_id, CASE WHEN good + bad > 0 THEN {sql_plain(_rate, 1)} END AS rate FROM x""",
    "alert_cooldown": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'),
n AS MATERIALIZED (SELECT a.user_id, a.event_id, first(b.event_id ORDER BY b.ts, b.event_id) AS following FROM e AS a JOIN e AS b ON a.user_id = b.user_id AND b.ts >= a.ts + INTERVAL 3 DAY GROUP BY 1, 2),
r AS (SELECT user_id, first(event_id ORDER BY ts, event_id) AS event_id FROM e GROUP BY 1 UNION ALL SELECT r.user_id, n.following FROM r JOIN n ON n.user_id = r.user_id AND n.event_id = r.event_id)
SELECT user_id, event_id FROM r""",
    "latest_event_per_user": """WITH x AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events)
SELECT * FROM x WHERE nth <= 2""",
}
