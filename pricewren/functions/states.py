"""States and bands as first-match rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def supplier_state(active: Column, failures: Column, price: Column, in_stock: Column, checked: Column, now: Column, stale_hours: int = 24) -> Column:
    """paused, error, pending (no price yet), out, stale (not checked for stale_hours) or ok; the first that holds."""
    late = checked.isNull() | (checked < now - F.make_dt_interval(F.lit(0), F.lit(stale_hours)))
    out = F.when(~active, "paused").when(failures > 0, "error").when(price.isNull(), "pending")
    return out.when(~in_stock, "out").when(late, "stale").otherwise("ok")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "certain").when(confidence >= 0.85, "high").when(confidence >= 0.70, "possible").otherwise("weak")


def attribute_map(pairs: Column) -> Column:
    """A map of an array of (key, value); the second and later ones of a key get _2, _3 behind it."""
    keys = F.transform(pairs, lambda p: p["key"])
    nth = lambda i: F.size(F.filter(F.slice(keys, F.lit(1), i + 1), lambda k: k == F.element_at(keys, i + 1)))
    named = F.transform(pairs, lambda p, i: F.struct(F.when(nth(i) > 1, F.concat(p["key"], F.lit("_"), nth(i).cast("string"))).otherwise(p["key"]).alias("key"), p["value"].alias("value")))
    return F.map_from_entries(named)


def simulated_price(price: Column, *keys: Column, seed: int = 0) -> Column:
    """A next observation of a price, fixed by keys and seed: a drift of up to 8 percent either way; one in twenty fails and is null."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), *keys), F.lit(1_000_000)).cast("double") / 1_000_000
    return F.when(draw(0) >= 0.05, F.floor(price * (0.92 + 0.16 * draw(1)) * 100 + 0.5).cast("double") / 100)
