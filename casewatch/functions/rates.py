"""Ratios with the two rounding rules of the indicators.

Half-even results use ``rint(x * 100) / 100`` and half-up results ``round``;
the two differ on ties, so each indicator names the rule it follows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(part, whole) -> Column:
    """Division as double; null instead of an error where the divisor is 0."""
    return F.try_divide(F.col(part) if isinstance(part, str) else part, whole).cast("double")


def round_half_even(value: Column) -> Column:
    return F.rint(value * 100) / 100


def percent_half_even(part, whole) -> Column:
    return round_half_even(ratio(part, whole) * 100)


def percent_half_up(part, whole) -> Column:
    return F.round(ratio(part, whole) * 100, 2)


def clip_upper(value: Column, cap: float) -> Column:
    """Cap a value and keep null null (`least` would turn null into the cap)."""
    return F.when(value > cap, F.lit(float(cap))).otherwise(value)


def capped_percent(part: Column, whole: Column, cap: float = 100) -> Column:
    """Percentage of capacity in use: full where there is use without capacity,
    null where there is neither."""
    overflow = (whole == 0) & (part > 0)
    return F.when(overflow, F.lit(float(cap))).otherwise(
        clip_upper(percent_half_even(part, whole), cap)
    )
