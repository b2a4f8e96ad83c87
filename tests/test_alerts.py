"""Alerts of a stream against those of windows over the same rows, however they arrive; an outbox whose channels fail and whose batches are repeated."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from pricewren.operators import series
from pricewren.plans.streams import ALERT
from pricewren.streaming import alerts, outbox, windows

START = datetime.datetime(2024, 5, 1)
COLUMNS = "product_id long, competitor_id long, event_id long, ts timestamp_ntz, ok boolean, price double, in_stock boolean, target_price double"


def made(rows: int, seed: int) -> list[tuple]:
    """Few products and listings, many ties in time and price, missing prices, stock and targets."""
    r = random.Random(seed)
    times = sorted(r.randrange(0, 6 * 3600) for _ in range(rows))
    return [
        (p := r.randrange(3), p * 10 + r.randrange(2), i, START + datetime.timedelta(seconds=t), r.random() < 0.6, r.choice([None, 5.0, 5.2, 7.5, 8.0, 20.0]), r.choice([None, True, False]), [None, 6.0, 8.0][p])
        for i, t in enumerate(times)
    ]


def rows_of(df) -> list:
    return sorted((tuple(r) for r in df.select(*[c.split()[0] for c in alerts.ALERTS.split(", ")]).collect()), key=str)


def test_worked_case(spark):
    at = lambda m: START + datetime.timedelta(minutes=m)
    rows = [
        (1, 1, 1, at(0), True, 10.0, True, 9.0), (1, 2, 2, at(1), True, 8.0, True, 9.0), (1, 1, 3, at(2), True, 7.0, None, 9.0), (1, 1, 4, at(3), True, 10.0, False, 9.0),
        (1, 1, 5, at(4), False, None, None, 9.0), (1, 1, 6, at(5), False, 3.0, None, 9.0), (1, 1, 7, at(90), False, None, None, 9.0), (1, 1, 8, at(91), True, 1.0, True, 9.0), (1, 2, 9, at(92), True, 6.5, True, 9.0),
        (None, 1, 10, at(93), True, 1.0, False, 9.0), (1, None, 11, at(93), True, 1.0, False, 9.0),
    ]
    found = series.observed_alerts(spark.createDataFrame(rows, COLUMNS), failures=2)
    assert sorted(tuple(r) for r in found.select("event_id", "type", "severity", "old_price", "new_price", "change_pct").collect()) == [
        (2, "all_time_low", "warning", None, 8.0, None), (2, "undercut", "critical", None, 8.0, None), (3, "all_time_low", "warning", 10.0, 7.0, -30.0), (3, "price_drop", "warning", 10.0, 7.0, -30.0), (3, "undercut", "critical", 10.0, 7.0, -30.0),
        (4, "out_of_stock", "info", 7.0, 10.0, 42.8571), (4, "price_rise", "info", 7.0, 10.0, 42.8571), (6, "scrape_failing", "warning", 7.0, 10.0, None), (7, "scrape_failing", "warning", 7.0, 10.0, None),
        (8, "price_drop", "warning", 10.0, 1.0, -90.0), (8, "undercut", "critical", 10.0, 1.0, -90.0), (9, "all_time_low", "warning", 8.0, 6.5, -18.75), (9, "price_drop", "warning", 8.0, 6.5, -18.75), (9, "undercut", "critical", 8.0, 6.5, -18.75),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_arrival_changes_nothing(spark, tmp_path, seed):
    """Rows come in five batches, up to fifty minutes late, in a stream that is started twice."""
    rows, r = made(400, seed), random.Random(seed)
    late = sorted(rows, key=lambda x: (x[3] + datetime.timedelta(minutes=r.randrange(50)), r.random()))
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    os.mkdir(source)

    def arrive(number: int) -> None:
        spark.createDataFrame(late[number * 80 : number * 80 + 80], COLUMNS).coalesce(1).write.parquet(str(tmp_path / f"part{number}"))
        (name,) = [f for f in os.listdir(tmp_path / f"part{number}") if f.startswith("part-")]
        os.rename(tmp_path / f"part{number}" / name, f"{source}/{number}.parquet")
        os.utime(f"{source}/{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))

    def run() -> list:
        stream = alerts.raised(windows.events_stream(spark, f"{source}/*.parquet", COLUMNS, per_trigger=1), failures=2, minutes=20)
        with windows.settings(spark, alerts.ROCKSDB):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return rows_of(spark.read.schema(stream.schema).parquet(out))

    def expected(arrived: list[tuple]) -> list:
        due = max(x[3] for x in arrived) - datetime.timedelta(hours=1)
        return rows_of(series.observed_alerts(spark.createDataFrame([x for x in arrived if x[3] <= due], COLUMNS), failures=2, minutes=20))

    for number in range(3):
        arrive(number)
    assert run() == expected(late[:240])
    for number in range(3, 5):
        arrive(number)
    found = run()
    assert found == expected(late) and {x[3] for x in found} == set(series.KINDS)


def test_no_rows(spark):
    assert series.observed_alerts(spark.createDataFrame([], COLUMNS)).count() == 0


def _alerts_stream(spark, tmp_path, rows):
    source = str(tmp_path / "alerts")
    spark.createDataFrame(rows, alerts.ALERTS).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(alerts.ALERTS).parquet(source)


def test_outbox(spark, tmp_path):
    """A channel that fails, one that raises, a retry, and a batch that is repeated after its progress was lost: nothing that was sent is sent again."""
    log, folder = tmp_path / "log", str(tmp_path / "box")
    log.mkdir()
    rows = [(1, n, n, "undercut", "critical", 2.0, 1.0, -50.0) for n in range(6)]

    def sender(name, fails):
        def send(frame):
            errors = []
            for delivery, event, attempt in zip(frame["delivery_id"], frame["event_id"], frame["attempt"]):
                errors.append(fails(event, attempt))
                if errors[-1] is None:
                    with open(f"{log}/{name}-{delivery}", "a") as f:
                        f.write(".")
            return errors

        return send

    def broken(frame):
        raise OSError("no route")

    channels = {"good": sender("good", lambda e, n: "busy" if e == 2 and n == 0 else "refused" if e == 3 else None), "broken": broken}
    state = lambda: {r["event_id"]: (r["delivery_status"], r["delivered_channels"], r["delivery_error"]) for r in outbox.status(spark, folder, alerts.ALERTS, ALERT, channels).collect()}
    assert state() == {}
    outbox.deliver(_alerts_stream(spark, tmp_path, rows), folder, str(tmp_path / "p1"), ALERT, channels)
    good = ("delivered", "good", "broken: no route")
    assert state() == {n: good for n in (0, 1, 4, 5)} | {n: ("failed", None, f"broken: no route; good: {e}") for n, e in ((2, "busy"), (3, "refused"))}
    outbox.deliver(spark.readStream.schema(alerts.ALERTS).parquet(str(tmp_path / "alerts")), folder, str(tmp_path / "p2"), ALERT, channels)
    for _ in range(2):
        outbox.retry(spark, folder, alerts.ALERTS, ALERT, channels, 1)
    assert state() == {n: good for n in (0, 1, 2, 4, 5)} | {3: ("failed", None, "broken: no route; good: refused")}
    assert len(os.listdir(log)) == 5 and all((log / f).read_text() == "." for f in os.listdir(log))


def test_outbox_without_channels(spark, tmp_path):
    folder = str(tmp_path / "box")
    outbox.deliver(_alerts_stream(spark, tmp_path, [(1, 1, 1, "undercut", "critical", None, 1.0, None)]), folder, str(tmp_path / "p"), ALERT, {})
    assert [r["delivery_status"] for r in outbox.status(spark, folder, alerts.ALERTS, ALERT, {}).collect()] == ["skipped"]
    assert outbox.status(spark, folder, alerts.ALERTS, ALERT, {"a": len}).agg(F.max("delivery_status")).first()[0] == "pending"
