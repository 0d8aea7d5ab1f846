"""Rows of the engine's own tables, made from scans."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from plumbline.functions.predicates import moment
from plumbline.operators.history import HISTORY_COLUMNS, SCORE_COLUMNS, history_rows

SCAN_TYPE = "DEEP"
# What was approved and what became of it; a fix of a preview was not run.
PREVIEW, APPROVED, EXECUTED = "PREVIEW", "APPROVED", "EXECUTED"
NOT_RUN, SUCCESS, FAILED = "NOT RUN", "SUCCESS", "FAILED"
EFFECTS = "table_name string, rule_name string, column_name string, changed_rows bigint, error string"


def scan_id(moment_column: Column, table: Column | None = None) -> Column:
    """SCAN_<date>_<time>_<table>; the table keeps scans of the same second apart."""
    stamp = F.date_format(moment_column.cast("timestamp_ntz"), "yyyyMMdd_HHmmss")
    return F.concat_ws("_", F.lit("SCAN"), stamp, table if table is not None else F.col("table_name"))


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns and types of a stored table; columns not given are null."""
    fields = StructType.fromDDL(ddl).fields
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])


def scan_result_rows(
    scores: DataFrame, columns: Mapping[str, int], database: str, schema: str, at: Column
) -> DataFrame:
    """One row per scanned table; `columns` gives each table's number of columns."""
    widths = F.create_map(*[F.lit(v) for pair in columns.items() for v in pair])
    return scores.select(
        scan_id(at).alias("scan_id"), at.cast("timestamp_ntz").alias("scan_timestamp"),
        F.lit(database).alias("database_name"), F.lit(schema).alias("schema_name"), "table_name", "total_rows",
        widths[F.col("table_name")].cast("long").alias("total_columns"), "issues_found", "critical_issues",
        "high_issues", "medium_issues", "low_issues", "health_score", *SCORE_COLUMNS,
        F.lit(SCAN_TYPE).alias("scan_type"),
    )


def scan_history_rows(scores: DataFrame, database: str, schema: str, at: Column) -> DataFrame:
    return history_rows(scores, scan_id(at), at.cast("date"), at, database, schema).select(*HISTORY_COLUMNS)


def issue_id() -> Column:
    return F.concat_ws("_", "scan_id", "rule_name", "column_name")


def issue_rows(issues: DataFrame, at: Column) -> DataFrame:
    return (
        issues.withColumn("scan_id", scan_id(at))
        .withColumn("issue_id", issue_id())
        .withColumn("confidence_level", F.col("confidence"))
        .withColumn("detected_at", at.cast("timestamp_ntz"))
    )


def remediation_rows(
    approved: DataFrame, compared: DataFrame, at: dt.date | dt.datetime, approved_by: str, status: str = PREVIEW,
    effects: DataFrame | None = None,
) -> DataFrame:
    """The log of fixes: the approved issues with their table's score before and after.

    `effects` (`EFFECTS`) says of fixes that were run how many rows each changed, or its error. Without, nothing
    was run: the rows are those that the issue affects, and nothing was executed.
    """
    now = moment(at).cast("timestamp_ntz")
    done = {"executed_at": F.lit(None).cast("timestamp_ntz"), "execution_result": F.lit(NOT_RUN)}
    if effects is not None:
        # A row for each fix.
        approved = approved.join(F.broadcast(effects), ["table_name", "rule_name", "column_name"], "left").withColumn(
            "affected_rows", F.coalesce("changed_rows", F.lit(0)).cast("bigint"))
        failed = F.col("error").isNotNull()
        done = {"executed_at": now, "execution_result": F.when(failed, F.concat(F.lit(f"{FAILED}: "), "error")).otherwise(SUCCESS)}
        status = EXECUTED
    scores = compared.select(
        "table_name", F.col("score_before").alias("before_score"), F.col("score_after").alias("after_score"))
    return (
        approved.withColumn("scan_id", scan_id(now))
        .withColumn("issue_id", issue_id())
        .join(F.broadcast(scores), "table_name")
        .select(
            F.concat_ws("_", F.lit("FIX"), "issue_id").alias("remediation_id"), "scan_id", "issue_id",
            "table_name", "column_name", F.col("rule_name").alias("issue_type"), "severity", "affected_rows",
            "remediation_sql", F.lit(status).alias("approval_status"), F.lit(approved_by).alias("approved_by"),
            now.alias("approved_at"), *[value.alias(name) for name, value in done.items()],
            "before_score", "after_score", now.alias("created_at"),
        )
    )


def newest_scans(results: DataFrame, n: int = 50) -> DataFrame:
    return results.select(
        "scan_id", "scan_timestamp", "table_name", "total_rows", "issues_found", "critical_issues", "health_score",
        "scan_type",
    ).orderBy(F.desc("scan_timestamp"), "scan_id").limit(n)


def newest_remediations(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("created_at"), "remediation_id").limit(n).select(
        "remediation_id", "table_name", "column_name", "issue_type", "severity", "affected_rows", "approval_status",
        "executed_at", "execution_result",
    )
