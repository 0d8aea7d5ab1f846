"""Exact rounding and score bands.

Percentages and scores are rounded half up on integers, so the same input gives
the same digits whatever the order of partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(numerator: Column, denominator: Column, digits: int) -> Column:
    """numerator / denominator for non-negative integers, half up; 0 for an empty denominator."""
    scale = 10**digits
    quotient = F.call_function("div", numerator * (2 * scale) + denominator, denominator * 2)
    return F.when(denominator > 0, quotient / F.lit(float(scale))).otherwise(F.lit(0.0))


def percent(part: Column, total: Column) -> Column:
    """100 * part / total with two decimals."""
    return half_up(part * 100, total, 2)


def to_units(value: Column, digits: int) -> Column:
    """A decimal that was rounded to `digits` places, as an exact integer count of its last place."""
    return F.round(value * 10**digits).cast("long")


def health_band(score: Column) -> Column:
    """Colour of a health score: 85 and up, 70 and up, 50 and up, below."""
    return (
        F.when(score >= 85, "green").when(score >= 70, "blue").when(score >= 50, "orange").otherwise("red")
    )


def dimension_band(score: Column) -> Column:
    """Colour of a dimension score: 80 and up, 60 and up, below."""
    return F.when(score >= 80, "green").when(score >= 60, "orange").otherwise("red")
