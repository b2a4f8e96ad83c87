"""All alerts of a stream of price observations, with keyed state, event-time timers and a cooldown.

An observation is product_id, competitor_id, event_id, ts, ok, price, in_stock, target_price (from a stream-static join); without a price it is a failed check.
State is kept by product: its lowest price, a map of its listings (two prices, failures in a row, whether it is checked still, when each kind of alert was
last raised), and the observations that wait for the watermark. Rows are taken in order of time and number once the watermark has passed
them, so the order in which they arrive within the delay changes nothing, and the stream's alerts are those of `series.observed_alerts` over the same rows. Rows later than the
watermark are dropped by Spark, those newer than it wait for the next run.

Memory: what waits is bounded by the rows of a product within the delay, the map by its listings. A product with a third of all rows is one task's work in each batch; batches
are bounded by the files they take (`maxFilesPerTrigger`). Cooldowns are event time: a state's TTL counts wall-clock time and would make results depend on when the stream runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricewren.operators.series import COOLDOWN, FAILURES, KINDS, PERCENT, SEVERITY

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ALERTS = "product_id long, competitor_id long, event_id long, type string, severity string, old_price double, new_price double, change_pct double"
WAITING = "at long, event_id long, competitor_id long, price double, in_stock boolean, target double"
LISTING = "price double, previous double, failures int, active boolean, " + ", ".join(f"{k}_at long" for k in KINDS)
NEW = (None, None, 0, True, *[None] * len(KINDS))


def rounded(x: float, digits: int) -> float:
    return math.floor((x + 2.220446049250313e-16) * 10**digits + 0.5) / 10**digits


def observe(listing: tuple, lowest: float | None, price: float | None, in_stock: bool | None, target: float | None, failures_at: int, percent: float) -> tuple[tuple, float | None, list[tuple]]:
    """A listing and its product's lowest price after an observation, and the alerts it gives rise to: (type, old price, new price, change in percent)."""
    known, previous, failures, active, *last = listing
    if price is None:
        failures += 1
        active = active and failures < failures_at
        return (known, previous, failures, active, *last), lowest, [("scrape_failing", previous, known, None)] if failures >= failures_at else []
    change = rounded((price - known) / known * 100, 4) if known else None
    met = {
        "undercut": target is not None and price < target,
        "price_drop": change is not None and change <= -percent,
        "price_rise": change is not None and change >= percent,
        "all_time_low": active and lowest is not None and price < lowest,
        "out_of_stock": in_stock is False,
    }
    if active:
        lowest = price if lowest is None else min(lowest, price)
    return (price, known, 0, active, *last), lowest, [(kind, known, price, change) for kind, yes in met.items() if yes]


class Alerts(StatefulProcessor):
    def __init__(self, failures: int, percent: float, minutes: int) -> None:
        self.failures, self.percent, self.span = failures, percent, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lowest = handle.getValueState("lowest", "price double")
        self.listings = handle.getMapState("listings", "competitor_id long", LISTING)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = [_row(r) for r in frame[["at", "event_id", "competitor_id", "price", "in_stock", "target_price"]].itertuples(index=False, name=None)]
            if new:
                self.waiting.appendList(new)
                first = min([r[0] for r in new] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [_row(r) for r in self.waiting.get()]
        due, rest = sorted((r for r in waiting if r[0] <= passed), key=lambda r: r[:2]), [r for r in waiting if r[0] > passed]
        if not due:
            return iter(())
        self.waiting.clear()
        if rest:
            self.waiting.appendList(rest)
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
        found = self.lowest.get()
        lowest, held, out = (_plain(found[0]) if found else None), {}, []
        for at, event_id, shop, price, in_stock, target in due:
            if shop not in held:
                held[shop] = tuple(map(_plain, self.listings.getValue((shop,)))) if self.listings.containsKey((shop,)) else NEW
            listing, lowest, met = observe(held[shop], lowest, price, in_stock, target, self.failures, self.percent)
            facts, last = listing[:4], list(listing[4:])
            for kind, old, new, change in met:
                k = KINDS.index(kind)
                if last[k] is None or at - last[k] >= self.span:
                    last[k] = at
                    out.append((key[0], shop, event_id, kind, SEVERITY[kind], old, new, change))
            held[shop] = (*facts, *last)
        for shop, listing in held.items():
            self.listings.updateValue((shop,), listing)
        if lowest is not None:
            self.lowest.update((lowest,))
        names = [c.split()[0] for c in ALERTS.split(", ")]
        return iter([pd.DataFrame(out, columns=names).astype({"old_price": "float64", "new_price": "float64", "change_pct": "float64"})] if out else ())

    def close(self) -> None:
        pass


def _plain(x):
    return None if x is None or x != x else x.item() if hasattr(x, "item") else x


def _row(r: tuple) -> tuple:
    return tuple(map(_plain, r))


def raised(observations: DataFrame, failures: int = FAILURES, percent: float = PERCENT, minutes: int = COOLDOWN) -> DataFrame:
    """Alerts that are raised by a stream of observations with a watermark on ts. Rows without a product or listing are left out. Runs on the RocksDB state
    store (`ROCKSDB`)."""
    price: Column = F.when(F.col("ok"), F.col("price"))
    rows = observations.where("product_id IS NOT NULL AND competitor_id IS NOT NULL").withColumn("at", F.unix_micros("ts")).withColumn("price", price)
    rows = rows.select("product_id", "competitor_id", "event_id", "ts", "at", "price", "in_stock", "target_price")
    return rows.groupBy("product_id").transformWithStateInPandas(statefulProcessor=Alerts(failures, percent, minutes), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime")
