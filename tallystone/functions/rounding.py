"""Rounding to decimal places by the exact binary value, halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double of 53 bits into two halves of at most 26.
_SPLIT = float((1 << 27) + 1)
#: From here on the nearest value with so many places is nearest to the double itself.
_WHOLE = float(1 << 53)


def _halves(x: Column) -> tuple[Column, Column]:
    c = F.lit(_SPLIT) * x
    high = c - (c - x)
    return high, x - high


def exact_round(value: Column, places: int = 0) -> Column:
    """``value`` to so many decimal places, from 0 to 15. What decides is the value that the double has and not the shortest decimal
    that stands for it: 2.675 is a little less than it looks, and gives 2.67. The product with the power of ten is taken without
    an error, as the sum of two doubles. Nulls, NaN, and values too large to have such places stay as they are."""
    if not 0 <= places <= 15:
        raise ValueError("places from 0 to 15 are exact")
    x, power = value.cast("double"), float(10**places)
    p = x * power
    xh, xl = _halves(x)
    c = _SPLIT * power
    power_high = c - (c - power)
    power_low = power - power_high
    rest = ((xh * power_high - p) + xh * power_low + xl * power_high) + xl * power_low
    floor = F.floor(p).cast("double")
    # the whole number below the exact product
    floor = floor - F.when((p == floor) & (rest < 0), 1.0).otherwise(0.0)
    over = (p - floor - 0.5) + rest
    whole = floor + F.when((over > 0) | ((over == 0) & (F.pmod(floor, F.lit(2.0)) == 1)), 1.0).otherwise(0.0)
    return F.when(F.isnan(x) | (F.abs(p) >= _WHOLE), x).otherwise(whole / power)
