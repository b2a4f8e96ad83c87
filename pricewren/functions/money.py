"""Money arithmetic on doubles, rounded half up towards positive infinity at fixed points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
#: The fixed conversion rate of the Bulgarian lev.
BGN_PER_EUR = 1.95583


def money_round(x: Column, digits: int = 2) -> Column:
    """floor((x + epsilon) * 10 ** digits + 0.5) / 10 ** digits: 1.005 gives 1.01 and -2.5 gives -2 at no digits."""
    scale = float(10**digits)
    return F.floor((x + F.lit(EPSILON)) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def plain_round(x: Column, digits: int = 2) -> Column:
    """As money_round, without the epsilon."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent_change(before: Column, after: Column, digits: int = 2) -> Column:
    """The change in percent of the earlier value; null where that is 0 or null."""
    return money_round(ratio(after - before, before) * 100, digits)


def exact_sum(x: Column) -> Column:
    """The sum of amounts of two decimals, free of the order of summation."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def exact_avg(x: Column) -> Column:
    return exact_sum(x) / F.count(x)


def convert(amount: Column, source: Column, target: Column, rates: dict[str, float] | None = None) -> Column:
    """An amount in another currency, by units of each currency per euro; unrounded where both are equal, null where a rate is missing."""
    table = {"EUR": 1.0, "BGN": BGN_PER_EUR} | (rates or {})
    per_euro = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))])
    converted = money_round(amount / F.try_element_at(per_euro, source) * F.try_element_at(per_euro, target))
    return F.when(source == target, amount).otherwise(converted)


def net_of_tax(amount: Column, vat_state: Column, vat_rate: Column) -> Column:
    """The amount without tax: only prices that include it are divided by 1 + rate."""
    return F.when((vat_state == "inclusive") & (vat_rate > 0), money_round(amount / (1 + vat_rate / 100))).otherwise(amount)


def trend(change_pct: Column) -> Column:
    """rising above 1 percent, falling below -1, else flat; unknown without a change."""
    return F.when(change_pct.isNull(), "unknown").when(change_pct > 1, "rising").when(change_pct < -1, "falling").otherwise("flat")
