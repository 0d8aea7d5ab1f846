"""Texts made from issues and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.issues import REPORT_ORDER


def explanations(issues: DataFrame) -> DataFrame:
    """What is wrong, what it risks and how to fix it, per issue."""
    text = F.concat(
        F.lit("- **What:** "), "issue_description", F.lit("\n- **Risk:** "), "business_impact",
        F.lit("\n- **Fix:** "), "recommended_action",
    )
    return issues.select("table_name", "column_name", "rule_name", text.alias("explanation"))


def _in_order(order: Sequence[Column], text: Column, separator: str, first: int) -> Column:
    """The first texts of a small relation in order, as one (an aggregate)."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, text.alias("text"))))
    return F.array_join(F.transform(F.slice(ordered, 1, first), lambda r: r["text"]), separator)


def context_summary(issues: DataFrame, history: DataFrame, top: int = 5, newest: int = 10) -> DataFrame:
    """One row that sums up the state: issue counts, the first issues, the newest scores.

    Issues are one per rule and column, so ordering them in an aggregate is bounded by the schema.
    """
    found = issues.agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        _in_order([F.col(c) for c in REPORT_ORDER], F.col("issue_description"), "; ", top).alias("top_issues"),
    )
    line = F.concat_ws(" ", "table_name", "health_score", "total_issues", "scan_date")
    scores = (
        history.orderBy(F.desc("recorded_at"), F.desc("scan_date"), "table_name", "scan_id").limit(newest)
        .agg(_in_order(
            [(-F.unix_date("scan_date")).alias("age"), F.col("table_name"), F.col("scan_id")], line, "\n", newest,
        ).alias("scores"))
    )
    parts = found.unionByName(scores, allowMissingColumns=True)
    whole = parts.agg(*[F.max(c).alias(c) for c in ("issues", "critical", "top_issues", "scores")])
    context = F.concat(
        F.lit("Scan found "), "issues", F.lit(" issues ("), "critical", F.lit(" critical). Top: "), "top_issues",
        F.lit("\nScores:\n"), "scores",
    )
    return whole.select("issues", "critical", "top_issues", "scores", context.alias("context"))
