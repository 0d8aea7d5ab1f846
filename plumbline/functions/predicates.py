"""Violation predicates. Each takes the column(s) under test and is true (never null-safe) on a bad row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, functions as F

# The accepted e-mail and phone formats and the amount tolerance.
# Patterns end in \z because Java's $ also matches before a trailing newline.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
PHONE_PATTERN = r"^\+?[0-9][0-9 ()-]{6,18}[0-9]\z"
AMOUNT_TOLERANCE = Decimal("0.01")


def is_null(c: Column) -> Column:
    return c.isNull()


def is_blank(c: Column) -> Column:
    return F.trim(c) == ""


def is_padded(c: Column) -> Column:
    return c != F.trim(c)


def _not_matching(c: Column, pattern: str) -> Column:
    text = c.cast("string")
    return (F.trim(text) != "") & ~text.rlike(pattern)


def is_bad_email(c: Column) -> Column:
    return _not_matching(c, EMAIL_PATTERN)


def is_bad_phone(c: Column) -> Column:
    return _not_matching(c, PHONE_PATTERN)


def is_negative(c: Column) -> Column:
    return c < 0


def moment(value: dt.date | dt.datetime) -> Column:
    """A date or a zone-less timestamp literal."""
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def is_after(c: Column, limit: dt.date | dt.datetime) -> Column:
    return c > moment(limit)


def is_before(c: Column, limit: dt.date | dt.datetime) -> Column:
    return c < moment(limit)


def is_not_allowed(c: Column, allowed: Sequence[str]) -> Column:
    return ~c.isin(list(allowed))


def is_out_of_order(start: Column, end: Column) -> Column:
    return end < start


def is_amount_off(total: Column, quantity: Column, price: Column) -> Column:
    return F.abs(total - quantity * price) > F.lit(AMOUNT_TOLERANCE)


def is_loss(cost: Column, price: Column) -> Column:
    return cost > price


def is_out_of_range(c: Column, low, high) -> Column:
    outside = [c < F.lit(low)] if low is not None else []
    outside += [c > F.lit(high)] if high is not None else []
    result = outside[0]
    for test in outside[1:]:
        result = result | test
    return result
