"""Accounts and drafts: limits of plans, renewal of quotas, the language of a shop, one form of JSON and seals over it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Products that a plan may watch, and comparisons by a model that it includes in each period.
PLAN_PRODUCTS = {"free": 10, "starter": 100, "pro": 500, "business": 2000}
PLAN_COMPARISONS = {"free": 50, "starter": 2000, "pro": 10000, "business": 50000}
PERIOD_DAYS = 30
# The language of a shop by the last part of its host, or else by a part before it.
LOCALE_ENDINGS = {"bg": "bg", "ro": "ro", "gr": "el"}
LOCALE_PARTS = {"bg": ("bg",), "ro": ("ro",), "el": ("gr", "el")}
#: Minutes that a sealed draft may be opened for.
SEAL_MINUTES = 60
_BLOCK = 64


def limit_of(plan: Column, limits: dict[str, int]) -> Column:
    """A plan's limit; null for an unknown plan."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), plan)


def used_in_period(used: Column, started: Column, now: Column) -> Column:
    """What counts as used: nothing where the period began more than PERIOD_DAYS ago or never, since it renews then."""
    return F.when(started.isNull() | (now > started + F.make_dt_interval(F.lit(PERIOD_DAYS))), 0).otherwise(used)


def locale_of(host: Column) -> Column:
    """bg, ro, el, or en where neither the country's domain nor a part before it tells."""
    parts = F.split(F.regexp_replace(F.lower(F.trim(host)), "^www[.]", ""), "[.]")
    last, before = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    under = F.size(parts) > 1
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for ending, locale in LOCALE_ENDINGS.items():
        out = out.when(under & (last == ending), locale)
    for locale, names in LOCALE_PARTS.items():
        out = out.when(F.arrays_overlap(before, F.array(*[F.lit(n) for n in names])), locale)
    return F.when(host.isNotNull(), out.otherwise("en"))


def _ordered(x: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in order, at all depths."""
    if isinstance(kind, T.StructType):
        fields = [_ordered(x[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _ordered(e, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(x))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _ordered(F.element_at(x, k), kind.valueType)))
    return x


def canonical_json(x: Column, kind: T.DataType) -> Column:
    """JSON of a struct or map of the given type that doesn't depend on the order of its fields; arrays keep their order, nulls are written."""
    return F.to_json(_ordered(x, kind), {"ignoreNullFields": "false"})


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The keyed digest of a text in hexadecimal digits, by two passes of SHA-256 over padded keys."""
    padded = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    keyed = lambda mask, data: F.sha2(F.concat(F.lit(bytes(b ^ mask for b in padded)), data), 256)
    return keyed(0x5C, F.unhex(keyed(0x36, message.cast("binary"))))


def sealed(payload: Column, issued: Column, key: bytes) -> Column:
    """The seal of a payload issued at a time (without a zone, to the second)."""
    return hmac_sha256(F.concat_ws(".", F.date_format(issued, "yyyyMMddHHmmss"), payload), key)


def opens(payload: Column, issued: Column, seal: Column, now: Column, key: bytes) -> Column:
    """Whether a seal is that of payload and time, and not older than SEAL_MINUTES."""
    fresh = now.between(issued, issued + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(SEAL_MINUTES)))
    return F.coalesce((sealed(payload, issued, key) == seal) & fresh, F.lit(False))
