"""Rounding that agrees with IEEE doubles rather than with their printed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1: cuts a double into two 26-bit halves


def round_binary(x: Column, digits: int) -> Column:
    """Round half-even on the exact binary value of a double.

    ``round`` works on the shortest decimal text, so 0.125 and 2.675 come out
    one step too high. The halves of ``x`` make the distance to the midpoint
    exact, and the comparison stays inside generated code.
    """
    scale = float(10**digits)
    a = F.abs(x.cast("double"))
    floor = F.floor(a * scale).cast("double")
    high = a * _SPLIT - (a * _SPLIT - a)
    low = a - high
    past_half = (high * (2.0 * scale) - (floor * 2.0 + 1.0)) + low * (2.0 * scale)
    up = (past_half > 0) | ((past_half == 0) & (F.pmod(floor, F.lit(2.0)) == 1))
    return F.signum(x.cast("double")) * (floor + F.when(up, 1.0).otherwise(0.0)) / scale


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """``round(part / whole, digits)`` with 0.0 for an empty whole."""
    safe = F.when(whole != 0, part.cast("double") / whole.cast("double"))
    return F.coalesce(round_binary(safe, digits), F.lit(0.0))


def mean_of(total: Column, count: Column, digits: int = 2) -> Column:
    return ratio(total, count, digits)
