"""The stream of alerts against a plain fold over the event log, and a stream that is started twice."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from pricewren.plans import streams
from pricewren.streaming import observations, windows

SF_DIR = "/root/testdata/sf0.001"


def test_alerts_against_a_fold(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").orderBy("ts", "event_id").collect()
    state, expected = {}, []
    for r in events:
        at = int(r["ts"].replace(tzinfo=datetime.UTC).timestamp() * 1_000_000 + 0.5)
        state[r["user_id"]], raised = observations.observe(state.get(r["user_id"], (None, None, 0, True, None, None, None, None)), r["event_type"] != "error", r["value"], at)
        expected += [(r["user_id"], r["event_id"], *x) for x in raised]
    found = [tuple(r) for r in streams.stream_observations(spark, SF_DIR).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str) and expected


def test_progress_is_kept(spark, tmp_path):
    """Files that arrive later are added to what was there, without counting rows twice."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run() -> int:
        rows = windows.first_claims(windows.events_stream(spark, f"{source}/*.parquet"), ["event_id"]).select("event_id")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    events.where(F.col("event_id") % 2 == 0).write.mode("append").parquet(str(source))
    first = run()
    events.where(F.col("event_id") % 2 == 1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 60 DAYS")).write.mode("append").parquet(str(source))
    assert (first, run()) == (events.where("event_id % 2 = 0").count(), events.count())
    assert run() == events.count()
