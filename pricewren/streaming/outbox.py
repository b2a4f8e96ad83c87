"""Alerts sent to several channels: stored first, then sent, each channel on its own, and what failed is sent again.

Below one folder lie `outbox` (the alerts of each batch) and `deliveries` (alert, channel, attempt, error: null where it was sent). Both are written by batch and
attempt, and a batch or attempt whose deliveries are complete isn't sent again, so a stream that is started anew repeats nothing it has finished. A task that is lost
midway sends its rows again: each row carries `delivery_id`, equal in every attempt, by which a channel knows repeats.

A channel is a function from a pandas frame of alerts (with delivery_id and attempt) to a list: an error, or None where the alert was sent; an exception is the
error of all its rows. It runs on executors, on frames of an Arrow batch's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.shared import exists

Channel = Callable[[pd.DataFrame], list]
SENT = "delivery_id string, channel string, attempt int, error string"
#: Longest text of an alert's errors.
ERROR_LENGTH = 1000


def _send(rows: DataFrame, channels: dict[str, Channel]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, part in frame.groupby("channel"):
                try:
                    errors = list(channels[name](part.drop(columns="channel")))
                except Exception as e:  # a channel's failure is a result
                    errors = [str(e) or type(e).__name__] * len(part)
                yield part[["delivery_id", "channel", "attempt"]].assign(error=pd.Series(errors, index=part.index, dtype=object))

    return rows.mapInPandas(run, SENT)


def _for_channels(alerts: DataFrame, keys: tuple[str, ...], channels: dict[str, Channel], attempt: int) -> DataFrame:
    rows = alerts.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    mark = F.to_json(F.struct(*keys, "channel"), {"ignoreNullFields": "false"})
    return rows.withColumn("delivery_id", F.sha2(mark, 256)).withColumn("attempt", F.lit(attempt))


def deliver(stream: DataFrame, folder: str, progress: str, keys: tuple[str, ...], channels: dict[str, Channel]) -> None:
    """Send a stream's alerts, over what is there; keys name an alert. Without channels alerts are stored alone."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        box, sent = f"{folder}/outbox/batch={number}", f"{folder}/deliveries/attempt=0/batch={number}"
        if not exists(spark, f"{box}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(box)
        if channels and not exists(spark, f"{sent}/_SUCCESS"):
            stored = spark.read.schema(batch.schema).parquet(box)
            _send(_for_channels(stored, keys, channels, 0), channels).drop("attempt").write.mode("overwrite").parquet(sent)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    if not exists(spark, f"{folder}/outbox"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/outbox")


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    schema = SENT + ", batch int"
    return spark.read.schema(schema).parquet(f"{folder}/deliveries") if exists(spark, f"{folder}/deliveries") else spark.createDataFrame([], schema)


def _state(spark: SparkSession, folder: str) -> DataFrame:
    """Each alert and channel: whether it was sent in any attempt, and the last error."""
    rows = _deliveries(spark, folder).groupBy("delivery_id", "channel")
    return rows.agg(F.bool_or(F.col("error").isNull()).alias("sent"), F.max_by("error", "attempt").alias("last_error"))


def retry(spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...], channels: dict[str, Channel], attempt: int) -> None:
    """Send again what no attempt has sent; an attempt that is complete, or of number 0, isn't repeated."""
    path = f"{folder}/deliveries/attempt={attempt}/batch=0"
    if attempt < 1 or not channels or exists(spark, f"{path}/_SUCCESS"):
        return
    sent = _state(spark, folder).where("sent").select("delivery_id")
    due = _for_channels(_stored(spark, folder, schema), keys, channels, attempt).join(sent, "delivery_id", "left_anti")
    _send(due, channels).drop("attempt").write.mode("overwrite").parquet(path)


def status(spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...], channels: dict[str, Channel]) -> DataFrame:
    """Each alert with delivery_status (delivered where any channel has it, failed, skipped without channels, pending before its first attempt), the channels that have it, and errors."""
    alerts = _stored(spark, folder, schema)
    if not channels:
        none = F.lit(None).cast("string")
        return alerts.select("*", F.lit("skipped").alias("delivery_status"), none.alias("delivered_channels"), F.lit("No notification channel configured").alias("delivery_error"))
    names = alerts.columns
    each = _for_channels(alerts, keys, channels, 0).drop("attempt").join(_state(spark, folder), ["delivery_id", "channel"], "left")
    joined = lambda when, what, mark: F.array_join(F.array_sort(F.collect_list(F.when(when, what))), mark)
    got, failed = F.coalesce("sent", F.lit(False)), F.col("sent").eqNullSafe(F.lit(False))
    rows = each.groupBy(*names).agg(
        F.when(F.bool_or(got), "delivered").when(F.bool_or(failed), "failed").otherwise("pending").alias("delivery_status"),
        joined(got, F.col("channel"), ",").alias("delivered_channels"),
        F.left(joined(failed, F.concat_ws(": ", "channel", "last_error"), "; "), F.lit(ERROR_LENGTH)).alias("delivery_error"),
    )
    return rows.withColumns({c: F.nullif(c, F.lit("")) for c in ("delivered_channels", "delivery_error")})
