"""Sums and means of doubles whose bits do not depend on the order of rows.

A double is cut into whole numbers of fixed units (2^30, 1, 2^-30, 2^-60, 2^-90);
these are added as integers, so partial sums may be merged in any order.
Only bits under 2^-90 are lost, the same ones of a value in every order. Values of
2^60 and more, infinities and NaN are added as they are. A group may have 2^33
values; beyond that the integer sums overflow with an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 30
_UNIT = float(1 << STEP)


def _whole(c: Column) -> Column:
    return c.cast("bigint")


def exact_sum(c: Column) -> Column:
    """An aggregate in place of ``sum``; NULL without values."""
    value = c.cast("double")
    small = F.abs(value) < float(1 << 60)  # false for NaN, which is greater than all
    rest, sums = F.when(small, value) / _UNIT, []
    for _ in range(5):
        part = _whole(rest)
        sums.append(F.sum(part))
        # Exact: the rest has the sign of the value and only its lower bits.
        rest = (rest - part) * _UNIT
    carry = F.lit(0).cast("bigint")
    low = []
    for total in (sums[4], sums[3]):
        total = total + carry
        carry = F.shiftright(total, STEP)
        low.append((total - F.shiftleft(carry, STEP)).cast("double"))
    wide = lambda s: s.cast("decimal(38,0)")
    unit = F.lit(1 << STEP).cast("decimal(10,0)")
    # One whole number in units of 2^-30, and what is below it.
    whole = (wide(sums[0]) * unit).cast("decimal(38,0)") + wide(sums[1])
    whole = (whole.cast("decimal(28,0)") * unit).cast("decimal(38,0)") + wide(sums[2] + carry)
    below = (low[1] + low[0] / _UNIT) / _UNIT / _UNIT
    large = F.sum(F.when(~small, value))
    total = whole.cast("double") / _UNIT + below
    return F.when(large.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + large)


def exact_mean(c: Column) -> Column:
    """An aggregate in place of ``avg``; NULL without values."""
    return F.try_divide(exact_sum(c), F.count(c))
