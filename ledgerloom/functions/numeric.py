"""Money arithmetic.

Sums of doubles depend on the order in which Spark merges partial results, so a
retried task or another partition count changes the last digits. Money here has
at most six decimals; summing whole micro-units makes every total repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1e6
LARGE = 9e12
LOW_BITS = 20
LOW_MASK = (1 << LOW_BITS) - 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_sum(c: Column | str) -> Column:
    """Sum of source-line amounts; NULL when no value is present.

    Each amount below 9e12 counts in whole micro-units (rounded to 1e-6). The integer is
    summed as a high and a low half, so neither long overflows before ~1e13 rows, and
    partial aggregation stays in plain longs. Larger amounts, whose doubles hold no
    micro-units, are summed as doubles and added at the end.
    """
    amount = _col(c)
    large = F.abs(amount) >= LARGE
    micro = F.rint(F.when(~large, amount) * MICRO).cast("long")
    beyond = F.sum(F.when(large, amount))
    high = F.sum(F.shiftright(micro, LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(micro.bitwiseAND(F.lit(LOW_MASK)))
    exact = (high * (1 << LOW_BITS) + low).cast("double") / MICRO
    return F.when(beyond.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + beyond)


def total_sum(c: Column | str) -> Column:
    """Exact sum of amounts that are already totals (few rows, any magnitude)."""
    return F.sum(_col(c).cast("decimal(38,6)")).cast("double")


def running_total(c: Column | str, window) -> Column:
    """Exact running sum over an ordered window of pre-aggregated totals."""
    return F.sum(_col(c).cast("decimal(38,6)")).over(window).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when the denominator is zero or either side is missing."""
    n, d = _col(num), _col(den)
    return F.when(d != 0, n / d)


def finite(c: Column | str) -> Column:
    """The value when it is a finite number, else NULL."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
