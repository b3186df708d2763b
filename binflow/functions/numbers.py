"""Rounding, clamping and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _exact(value: Column) -> Column:
    # Ten decimals absorb the noise of summing doubles in different orders, so a
    # rounding step sees 12.345 whatever the task layout.
    return value.cast("double").cast("decimal(28,10)")


def half_up(value: Column, digits: int) -> Column:
    """Database rounding of exact numerics: ties away from zero."""
    return F.round(_exact(value), digits).cast("double")


def half_even(value: Column, digits: int) -> Column:
    """Ties to the even digit, as application code rounds means and errors."""
    return F.bround(_exact(value), digits).cast("double")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """numerator/denominator rounded; null when the denominator is zero."""
    return F.when(denominator != 0, half_even(numerator / denominator, digits))
