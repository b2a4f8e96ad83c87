"""A Spark session with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "pricewren", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive execution with skew handling, Arrow. On a cluster leave master unset and size partitions there."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=conf).getOrCreate()
