"""The offending rows themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.binding import BoundRule, ForeignKey, ParentDate, col
from plumbline.operators.keyed import key_counts, parent_dates, parent_keys
from plumbline.operators.salting import keep_matching


def failing_rows(df: DataFrame, bound: BoundRule) -> DataFrame:
    """Rows that break a row rule; the filter reaches the scan."""
    return df.where(bound.predicate(col))


def orphan_keys(df: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Distinct references without a parent, with their number of rows.

    An outer join with a filter: an anti-join would be moved below the counting by the optimizer,
    and all rows of a reference would meet in one task.
    """
    references = key_counts(df.where(col(fk.column).isNotNull()), [fk.column])
    known = parent_keys(parent, fk.parent_key, fk.column).withColumn("known", F.lit(True))
    return references.join(known, fk.column, "left").where("known IS NULL").drop("known")


def orphan_rows(df: DataFrame, fk: ForeignKey, parent: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Rows whose reference names no parent; each distinct reference is looked up once."""
    return keep_matching(df, orphan_keys(df, fk, parent), spread_by)


def early_pairs(df: DataFrame, link: ParentDate, parent: DataFrame) -> DataFrame:
    """Distinct (reference, date) pairs with a date before the parent's, with their number of rows."""
    pairs = key_counts(df, [link.foreign_key, link.column])
    limits = parent_dates(parent, link, link.foreign_key)
    return pairs.join(limits, link.foreign_key).where(col(link.column) < col("parent_date")).drop("parent_date")
