"""Counting the violations of all row rules of a table in one aggregation.

Every branch of a scan, here and in the keyed operators, yields the same small relation:
one row per (phase, bound rule, group) with the affected rows, the groups of copies and
the total rows. A branch counts its own total, so branches meet in a union, never a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.binding import BoundRule, Resolver, col

CURRENT = "current"
COUNTER_COLUMNS = (
    "phase string, rule_index int, affected_rows bigint, duplicate_groups bigint, total_rows bigint"
)
# Generated aggregate code beyond about this many counters no longer compiles well.
MAX_COUNTERS = 100


def counter_rows(wide: DataFrame, by: Sequence[str], counters: Sequence[tuple]) -> DataFrame:
    """Turns one wide row of aggregates into counter rows.

    Each counter is (rule index, phase, column of affected rows, of duplicate groups or None, of total rows).
    """
    rows = ", ".join(
        f"struct('{phase}' AS phase, {index} AS rule_index, {_count(affected)} AS affected_rows, "
        f"{_count(groups)} AS duplicate_groups, {_count(total)} AS total_rows)"
        for index, phase, affected, groups, total in counters
    )
    return wide.selectExpr(*[f"`{c}`" for c in by], f"inline(array({rows}))")


def _count(column: str | None) -> str:
    return f"CAST(coalesce({column}, 0) AS BIGINT)" if column else "0L"


def _by_columns(rules: Sequence[tuple[int, BoundRule]], per_chunk: int) -> list[list[tuple[int, BoundRule]]]:
    """Chunks of rules; rules on the same columns stay together, so chunks read disjoint columns."""
    ordered = sorted(rules, key=lambda r: (r[1].ordinal, r[1].rule.seq))
    return [ordered[i:i + per_chunk] for i in range(0, len(ordered), per_chunk)]


def count_row_rules(
    df: DataFrame,
    rules: Sequence[tuple[int, BoundRule]],
    by: Sequence[str] = (),
    phases: Mapping[str, Resolver] | None = None,
) -> list[DataFrame]:
    """Violations of row rules, one scan per `MAX_COUNTERS` counters.

    `phases` names several versions of the same rows (for example before and after fixing):
    all are counted while the table is read once.
    """
    phases = phases or {CURRENT: col}
    branches = []
    for chunk in _by_columns(rules, max(1, MAX_COUNTERS // len(phases))):
        counts, rows = [], []
        for index, bound in chunk:
            for phase, get in phases.items():
                name = f"n_{index}_{phase}"
                counts.append(F.count_if(bound.predicate(get)).alias(name))
                rows.append((index, phase, name, None, "n_total"))
        wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), *counts)
        branches.append(counter_rows(wide, by, rows))
    return branches


def any_violation(rules: Sequence[BoundRule], get: Resolver = col) -> Column:
    """True on a row that breaks at least one row rule, else false (never null)."""
    hit = F.lit(False)
    for bound in rules:
        if bound.predicate is not None:
            hit = hit | F.coalesce(bound.predicate(get), F.lit(False))
    return hit
