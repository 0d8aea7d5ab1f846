"""Score history: latest scans, trends and what changed.

A history has one row per table and scan (`schemas.HEALTH_SCORE_HISTORY`); scores are read to
hundredths, so means do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.numbers import half_up, to_units
from plumbline.operators.scoring import score_column
from plumbline.rules import DIMENSIONS

SCORE_COLUMNS = tuple(score_column(d) for d in DIMENSIONS)
HISTORY_COLUMNS = (
    "scan_id", "scan_date", "database_name", "schema_name", "table_name", "health_score", *SCORE_COLUMNS,
    "total_issues", "critical_issues", "rows_at_risk", "recorded_at",
)


def mean_score(column: str, digits: int = 2) -> Column:
    """Mean of a score column, two decimals unless more are asked for."""
    return half_up(F.sum(to_units(F.col(column), 2)), F.count(column) * 100, digits)


def history_rows(scored: DataFrame, scan_id: Column, scan_date: Column, recorded_at: Column,
                 database: str, schema: str) -> DataFrame:
    """Score rows of a scan as history rows."""
    return scored.select(
        scan_id.alias("scan_id"), scan_date.alias("scan_date"), F.lit(database).alias("database_name"),
        F.lit(schema).alias("schema_name"), "table_name", "health_score", *SCORE_COLUMNS,
        F.col("issues_found").alias("total_issues"), "critical_issues", "rows_at_risk",
        recorded_at.cast("timestamp_ntz").alias("recorded_at"),
    )


def latest(history: DataFrame) -> DataFrame:
    """All rows of the newest scan date; a partitioned history is read at that date only."""
    newest = history.agg(F.max("scan_date").alias("scan_date"))
    return history.join(F.broadcast(newest), "scan_date")


def latest_per_table(history: DataFrame) -> DataFrame:
    """The newest scan of every table."""
    order = F.struct("scan_date", "recorded_at", "scan_id")
    newest = history.groupBy("table_name").agg(
        F.max_by(F.struct(*[F.col(c) for c in history.columns]), order).alias("row")
    )
    return newest.select("row.*")


def trend(history: DataFrame, digits: int = 2) -> DataFrame:
    """Mean score, issues and rows at risk per date."""
    return (
        history.groupBy("scan_date")
        .agg(
            mean_score("health_score", digits).alias("score"),
            F.sum("total_issues").alias("issues"),
            F.sum("rows_at_risk").alias("rows_at_risk"),
        )
        .orderBy("scan_date")
    )


def kpis(history: DataFrame) -> DataFrame:
    return latest(history).agg(
        mean_score("health_score").alias("health_score"),
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("total_issues"), F.lit(0)).alias("issues"),
        F.coalesce(F.sum("critical_issues"), F.lit(0)).alias("critical"),
        F.coalesce(F.sum("rows_at_risk"), F.lit(0)).alias("rows_at_risk"),
    )


def mean_dimensions(history: DataFrame) -> DataFrame:
    means = latest(history).agg(*[mean_score(c).alias(c) for c in SCORE_COLUMNS])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(score_column(d)).alias("score")) for d in DIMENSIONS
    ])))


# Differences of means are taken on more decimals than are shown.
FINE = 6


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def _difference(a: str, b: str) -> Column:
    """a - b of two fine means, as an exact count of their last place."""
    return to_units(F.col(a), FINE) - to_units(F.col(b), FINE)


def _rounded(units: Column) -> Column:
    """Fine units to two decimals, half up away from zero."""
    return F.signum(units) * _div(F.abs(units) + 5 * 10 ** (FINE - 3), 10 ** (FINE - 2)) / 100.0


def _text_tenths(units: Column) -> Column:
    """Fine units as text with one decimal, without sign."""
    tenths = _div(F.abs(units) + 5 * 10 ** (FINE - 2), 10 ** (FINE - 1))
    return F.concat(_div(tenths, 10), F.lit("."), tenths % 10)


def trust_delta(history: DataFrame) -> DataFrame:
    """First and last point of the trend."""
    points = trend(history, FINE).agg(
        F.min("scan_date").alias("first_date"), F.max("scan_date").alias("last_date"),
        F.min_by("score", "scan_date").alias("first_score"), F.max_by("score", "scan_date").alias("last_score"),
        F.max_by("issues", "scan_date").alias("issues"), F.max_by("rows_at_risk", "scan_date").alias("rows_at_risk"),
    )
    return points.withColumn("delta", _rounded(_difference("last_score", "first_score")))


def trust_change(history: DataFrame) -> DataFrame:
    """Last date against the one before; empty with fewer than two dates."""
    last_two = trend(history, FINE).orderBy(F.desc("scan_date")).limit(2)
    pair = last_two.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("scan_date").alias("scan_date"),
        F.max_by("score", "scan_date").alias("score"), F.min_by("score", "scan_date").alias("previous_score"),
        F.max_by("issues", "scan_date").alias("issues"), F.min_by("issues", "scan_date").alias("previous_issues"),
    ).where("n = 2").drop("n")
    units = _difference("score", "previous_score")
    message = (
        F.when(units > 0, F.concat(
            F.lit("Trust improved +"), _text_tenths(units), F.lit(" pts. Issues: "),
            F.col("previous_issues"), F.lit(" → "), F.col("issues")))
        .when(units < 0, F.concat(
            F.lit("Trust dropped -"), _text_tenths(units), F.lit(" pts. Investigate recent ingestion.")))
        .otherwise("Stable since last scan.")
    )
    return pair.withColumns({"change": _rounded(units), "message": message})


def changes_over_time(scored: DataFrame) -> DataFrame:
    """Each period's health with the change from the period before, per table."""
    earlier = F.lag("health_score").over(Window.partitionBy("table_name").orderBy("scan_date"))
    return scored.withColumn("previous_score", earlier).withColumn(
        "change", (to_units(F.col("health_score"), 1) - to_units(F.col("previous_score"), 1)) / 10.0
    )
