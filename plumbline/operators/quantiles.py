"""Exact quantiles of whole columns by a radix descent on order-preserving integer keys.

Every value has an integer key in the order of its type: the number itself, a decimal's unscaled digits, the
bits of a double. A wanted rank starts with the keys from the least to the greatest value. Each round cuts
the keys that are left into equal parts, counts the values below every cut, for all columns in one
aggregate, and keeps the part that holds the rank, narrowed to the values it has. So a round needs a few
counters for each column and nothing else, whatever the table: no value is copied, sorted or shuffled.

A part with one value, or with few enough rows to sort in one row's array, ends the descent. The keys
are only known to the driver; the table is compared with values of the column's own type, so integers
beyond 2^53 and long decimals keep every digit.

Nulls take no part. NaN ranks above every number, infinity included, as in Spark's own ordering.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.binding import col
from plumbline.operators.rowscan import MAX_COUNTERS
from plumbline.sources.values import literal_rows

GATHERED = 50_000  # values that one array may hold
CUTS = 3  # of the keys of a rank in a round; more make fewer rounds, but no compiled aggregate
QUANTILES = "column_name string, prob double, value double, exact string"
_SIGN = 1 << 63


class Keys:
    """The keys of a column's type, and comparisons of the column with the value of a key."""

    def __init__(self, df: DataFrame, name: str):
        self.name, self.type = name, df.schema[name].dataType
        self.is_float = isinstance(self.type, (T.FloatType, T.DoubleType))
        self.scale = self.type.scale if isinstance(self.type, T.DecimalType) else 0
        value = col(name).cast("double") if self.is_float else col(name)
        # NaN is counted apart.
        self.value = F.when(~F.isnan(value), value) if self.is_float else value

    def of(self, value) -> int:
        if self.is_float:
            bits = struct.unpack("<q", struct.pack("<d", value + 0.0))[0]  # -0.0 equals 0.0
            return bits if bits >= 0 else -(bits + _SIGN)
        return int(Fraction(value) * 10 ** self.scale)

    def number(self, key: int):
        """The value of a key: exact, or a double."""
        if self.is_float:
            return struct.unpack("<d", struct.pack("<q", key if key >= 0 else -key - _SIGN))[0]
        return Fraction(key, 10 ** self.scale)

    def literal(self, key: int) -> Column:
        if self.is_float:
            return F.lit(self.number(key))
        return F.lit(f"{key}E-{self.scale}").cast(self.type) if isinstance(self.type, T.DecimalType) else F.lit(key).cast("bigint")


@dataclass
class Rank:
    """A wanted rank of a column and the keys it may have: `below` values are less than the first."""

    keys: Keys
    rank: int
    low: int
    high: int
    below: int
    inside: int
    value: object = None
    following: object = None  # of the next rank

    @property
    def is_open(self) -> bool:
        return self.low < self.high and self.inside > GATHERED

    def cuts(self, n: int) -> list[int]:
        """First keys of the parts but the first."""
        size = self.high - self.low + 1
        return sorted({self.low + size * j // (n + 1) for j in range(1, n + 1)} - {self.low})


def _one_row(df: DataFrame, aggregates: Sequence[Column]) -> list:
    """The aggregates of a table; in passes of at most MAX_COUNTERS."""
    found: list = []
    for start in range(0, len(aggregates), MAX_COUNTERS):
        named = [a.alias(f"a{i}") for i, a in enumerate(aggregates[start:start + MAX_COUNTERS])]
        found += list(df.agg(*named).first())
    return found


def _within(rank: Rank) -> Column:
    return rank.keys.value.between(rank.keys.literal(rank.low), rank.keys.literal(rank.high))


def _narrow(df: DataFrame, ranks: Sequence[Rank]) -> None:
    """One round: the part of the keys that holds each rank, between the values that it has."""
    cuts = [rank.cuts(CUTS) for rank in ranks]
    wanted = []
    for rank, keys in zip(ranks, cuts, strict=True):
        wanted += [F.count_if(rank.keys.value < rank.keys.literal(key)) for key in keys]
        wanted += [F.min(F.when(_within(rank), rank.keys.value)), F.max(F.when(_within(rank), rank.keys.value))]
    counted = iter(_one_row(df, wanted))
    for rank, keys in zip(ranks, cuts, strict=True):
        edges, upto = [rank.low, *keys, rank.high + 1], rank.below + rank.inside
        below = [rank.below, *[next(counted) for _ in keys], upto]
        least, greatest = rank.keys.of(next(counted)), rank.keys.of(next(counted))
        part = max(i for i in range(len(edges) - 1) if below[i] <= rank.rank)
        rank.low, rank.high = max(edges[part], least), min(edges[part + 1] - 1, greatest)
        rank.below, rank.inside = below[part], below[part + 1] - below[part]


def _finish(df: DataFrame, ranks: Sequence[Rank]) -> None:
    """The values of the ranks and of the ranks after them; what is left of each is sorted in one array."""
    wanted = []
    for rank in ranks:
        place, beyond = rank.rank - rank.below, F.min(F.when(rank.keys.value > rank.keys.literal(rank.high), rank.keys.value))
        if rank.low == rank.high:
            first = F.lit(None)
            then = F.lit(None) if place + 1 < rank.inside else beyond
        else:
            held = F.array_sort(F.collect_list(F.when(_within(rank), rank.keys.value)))
            first = F.get(held, F.lit(place))
            then = F.coalesce(F.get(held, F.lit(place + 1)), beyond)
        wanted += [first, then]
    found = iter(_one_row(df, wanted))
    for rank in ranks:
        first, then = next(found), next(found)
        rank.value = rank.keys.number(rank.low if first is None else rank.keys.of(first))
        rank.following = None if then is None else rank.keys.number(rank.keys.of(then))
        if rank.low == rank.high and rank.rank - rank.below + 1 < rank.inside:
            rank.following = rank.value


def _between(lower, upper, fraction: Fraction):
    """Linear interpolation; exact for exact numbers."""
    if lower == upper or not fraction:
        return lower
    if not isinstance(lower, float):
        return lower + (upper - lower) * fraction
    share = float(fraction)
    if lower == float("-inf"):
        return lower * (1 - share) + upper * share
    return lower + (upper - lower) * share


def _digits(number: Fraction) -> str:
    """A number to four places, half up away from zero."""
    units = (abs(number) * 10_000 + Fraction(1, 2)).__floor__()
    return f"{'-' if number < 0 and units else ''}{units // 10_000}.{units % 10_000:04d}"


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column_name, prob, value, exact): linearly interpolated quantiles of the non-null values.

    `value` is a double; `exact` has every digit of an integer or decimal, to four places, as text.
    A column without values has no row. Runs its rounds when it is called.
    """
    keys = [Keys(df, name) for name in columns]
    aggregates = []
    for k in keys:
        aggregates += [F.count(col(k.name)), F.count(k.value), F.min(k.value), F.max(k.value)]
    found = iter(_one_row(df, aggregates))
    rows, asked = [], []
    for k in keys:
        n, numbers, least, greatest = (next(found) for _ in range(4))
        for prob in probs if n else ():
            position = (n - 1) * Fraction(str(prob))
            lower = int(position)
            rank = None if lower >= numbers else Rank(k, lower, k.of(least), k.of(greatest), 0, numbers)
            asked.append((k, prob, position - lower, rank))
    ranks = [rank for *_, rank in asked if rank]
    while still := [rank for rank in ranks if rank.is_open]:
        _narrow(df, still)
    if ranks:
        _finish(df, ranks)
    for k, prob, fraction, rank in asked:
        nan = float("nan")
        lower = rank.value if rank else nan
        upper = lower if not fraction else rank.following if rank and rank.following is not None else nan
        value = _between(lower, upper, fraction)
        rows.append((k.name, float(prob), float(value), None if k.is_float else _digits(value)))
    return literal_rows(df.sparkSession, QUANTILES, rows)
