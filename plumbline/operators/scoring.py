"""Dimension and health scores.

A dimension loses 2 points per affected percent, a penalty per severity and 3 points per issue,
80 at most; the health score is the weighted sum. All sums are integers (hundredths of a point).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.numbers import to_units
from plumbline.rules import DIMENSIONS, OTHER_PENALTY, SEVERITY_PENALTY, WEIGHTS

ISSUE_PENALTY = 3
MAX_PENALTY = 80


def load_weights(weights: DataFrame) -> dict[str, str]:
    """Weights from a stored weight table (one row per dimension)."""
    return {row.dimension: str(row.weight) for row in weights.select("dimension", "weight").collect()}


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def issue_penalty() -> Column:
    """Points an issue costs its dimension, in hundredths."""
    severity = F.when(F.lit(False), 0)
    for name, points in SEVERITY_PENALTY.items():
        severity = severity.when(F.col("severity") == name, points)
    severity = severity.otherwise(OTHER_PENALTY)
    return to_units(F.col("affected_percentage"), 2) * 2 + (severity + ISSUE_PENALTY) * 100


def score_column(dimension: str) -> str:
    return f"{dimension.lower()}_score"


def score_tables(
    graded: DataFrame, by: Sequence[str] = ("table_name",), weights: Mapping[str, str] = WEIGHTS
) -> DataFrame:
    """One row per scanned table (and phase or period in `by`): scores, issue counts, rows at risk.

    Takes graded counters, not only fired ones, so that a table without any issue scores 100.
    """
    fired = F.col("affected_rows") > 0
    tenths = []
    for dimension in DIMENSIONS:
        lost = F.least(
            F.coalesce(
                F.sum(F.when(fired & (F.col("rule_category") == dimension), issue_penalty())), F.lit(0)
            ),
            F.lit(MAX_PENALTY * 100),
        )
        tenths.append(_div(F.lit(10000) - lost + 5, 10).alias(score_column(dimension)))
    counts = [
        F.count_if(fired & (F.col("severity") == name)).alias(f"{name.lower()}_issues")
        for name in SEVERITY_PENALTY
    ]
    sums = graded.groupBy(*by).agg(
        F.max("total_rows").alias("total_rows"),
        F.count_if(fired).alias("issues_found"),
        *counts,
        F.coalesce(F.sum(F.when(fired, F.col("affected_rows"))), F.lit(0)).alias("rows_at_risk"),
        *tenths,
    )
    thousandths = F.lit(0)
    for dimension, weight in weights.items():
        thousandths = thousandths + F.col(score_column(dimension)) * round(float(weight) * 100)
    health = _div(thousandths + 50, 100) / 10.0
    scored = sums.withColumn("health_score", health)
    return scored.withColumns({score_column(d): F.col(score_column(d)) / 10.0 for d in DIMENSIONS})


def dimension_scores(scored: DataFrame, by: Sequence[str] = ("table_name",)) -> DataFrame:
    """Score rows turned to one row per dimension."""
    rows = [
        F.struct(F.lit(d).alias("dimension"), F.col(score_column(d)).alias("score")) for d in DIMENSIONS
    ]
    return scored.select(*by, F.inline(F.array(*rows)))
