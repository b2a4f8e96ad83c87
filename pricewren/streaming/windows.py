"""Event-time windows, duplicate claims and listings' state on Structured Streaming.

Sources are folders (or a pattern) of Parquet files with a known schema; event times without a zone are read as UTC. Every job runs over
what is there (`availableNow`), keeps its progress in the shared checkpoint folder, and goes on from there when it is started again, so a
lost executor or driver costs no rows. Late rows are those behind the watermark; batch and stream agree where nothing is late.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.shared import shared_root

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, path: str, schema: str = EVENTS, watermark: str = "1 hour", per_trigger: int = 100) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(rows: DataFrame, length: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Count and sum of values by window of event time and keys; with slide, windows that overlap."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n", "total")


def sessions(rows: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Sessions of each key: they end when nothing comes for the gap."""
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n")


def first_claims(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return rows.dropDuplicatesWithinWatermark(keys)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for a stream that is started within; a stream keeps what it was started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialised(stream: DataFrame, spark: SparkSession, tag: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over what is there and read its result.

    append writes finished rows as files; update writes each batch's new values beside the old ones with the batch's number, and the newest
    of each of `keys` counts. Either way a batch that runs twice leaves one copy of its rows.
    """
    out, state = shared_folder(spark, tag), shared_folder(spark, f"{tag}-progress")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    from pyspark.sql import types as T

    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    newest = F.max_by(F.struct(*stream.columns), "batch").alias("r")
    return rows.groupBy(*keys).agg(newest).select("r.*")


