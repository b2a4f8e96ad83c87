"""The state of listings over a stream of observations: price, extremes, failures in a row, alerts with a cooldown.

One state for each listing (user of the event log): a few numbers, so memory grows with the number of listings alone. Observations of a
batch are taken in order of time, then of number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures in a row at which a listing is given up, least change in percent of an alert, and minutes in which an alert is not repeated.
FAILURES, PERCENT, COOLDOWN = 10, 5.0, 60
ALERTS = "user_id long, event_id long, type string, old_price double, new_price double"
STATE = "price double, lowest double, failures int, active boolean, drop_at long, rise_at long, low_at long, failing_at long"


def observe(state: tuple, ok: bool, price: float | None, at: int) -> tuple[tuple, list[tuple[str, float | None, float | None]]]:
    """The state after one observation at a time in microseconds, and the alerts that it raises: (type, old price, new price)."""
    known, lowest, failures, active, *last = state
    raised = []

    def alert(kind: int, name: str, old: float | None, new: float | None) -> None:
        if last[kind] is None or at - last[kind] >= COOLDOWN * 60_000_000:
            last[kind] = at
            raised.append((name, old, new))

    if not ok or price is None:
        failures += 1
        if failures == FAILURES:
            active = False
            alert(3, "scrape_failing", known, None)
        return (known, lowest, failures, active, *last), raised
    if known:
        change = (price - known) / known * 100
        if change <= -PERCENT:
            alert(0, "price_drop", known, price)
        elif change >= PERCENT:
            alert(1, "price_rise", known, price)
    if lowest is not None and price < lowest:
        alert(2, "all_time_low", known, price)
    return (price, price if lowest is None else min(lowest, price), 0, active, *last), raised


def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    state = group.get if group.exists else (None, None, 0, True, None, None, None, None)
    state = tuple(None if x is None or x != x else x for x in state)
    out = []
    rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
    for ok, value, event_id, at in zip(rows["event_type"] != "error", rows["value"], rows["event_id"], rows["at"]):
        state, raised = observe(state, bool(ok), None if pd.isna(value) else float(value), int(at))
        out += [(key[0], event_id, *r) for r in raised]
    group.update(state)
    yield pd.DataFrame(out, columns=["user_id", "event_id", "type", "old_price", "new_price"])


def alerts(observations: DataFrame) -> DataFrame:
    """Alerts of a stream of observations (user_id, event_id, ts, event_type, value); type error stands for a failure."""
    rows = observations.select("user_id", "event_id", F.unix_micros("ts").alias("at"), "event_type", "value")
    return rows.groupBy("user_id").applyInPandasWithState(fold, ALERTS, STATE, "append", GroupStateTimeout.NoTimeout)
