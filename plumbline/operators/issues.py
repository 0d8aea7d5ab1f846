"""From counters to issue rows, and the listings made from issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.binding import BoundRule
from plumbline.functions.numbers import percent
from plumbline.rules import NULL_GRADES, SEVERITY_PENALTY
from plumbline.sources.values import literal_rows

RULE_COLUMNS = (
    "rule_index int, table_name string, column_name string, rule_seq int, ordinal int, rule_category string, "
    "rule_name string, fixed_severity string, risk_level string, confidence double, description string, "
    "business_impact string, recommended_action string, remediation_sql string, catalog_rule string, "
    "type_family string"
)
REPORT_ORDER = ("table_name", "rule_seq", "ordinal", "column_name")


def rule_table(spark: SparkSession, bound: Sequence[BoundRule]) -> DataFrame:
    """The bound rules as a relation; as many rows as rules times columns, whatever the data."""
    return literal_rows(spark, RULE_COLUMNS, [
        (
            i, b.table, b.column, b.rule.seq, b.ordinal, b.rule.category, b.rule.name, b.rule.severity,
            b.rule.risk, b.rule.confidence, b.text(b.rule.description), b.text(b.rule.impact),
            b.text(b.rule.action), b.text(b.rule.remediation), b.rule.catalog, b.family,
        )
        for i, b in enumerate(bound)
    ])


def severity_of(fixed: Column, pct: Column) -> Column:
    graded = F.when(fixed != "", fixed)
    for above, grade in NULL_GRADES:
        graded = graded.when(pct > above, grade)
    return graded.otherwise("LOW")


def severity_rank(severity: Column) -> Column:
    """1 for the worst severity."""
    rank = F.when(F.lit(False), 0)
    for i, name in enumerate(SEVERITY_PENALTY, start=1):
        rank = rank.when(severity == name, i)
    return rank.otherwise(len(SEVERITY_PENALTY) + 1)


def grade(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Counters with their rule, percentage, severity and description; rules that did not fire included."""
    described = F.replace(F.col("description"), F.lit("{n}"), F.format_number("affected_rows", 0))
    described = F.replace(described, F.lit("{pct}"), F.col("affected_percentage").cast("string"))
    described = F.replace(described, F.lit("{groups}"), F.col("duplicate_groups").cast("string"))
    pct = percent(F.col("affected_rows"), F.col("total_rows"))
    return (
        counts.join(F.broadcast(rules), "rule_index")
        .withColumn("affected_percentage", pct)
        .withColumns({
            "severity": severity_of(F.col("fixed_severity"), F.col("affected_percentage")),
            "issue_description": described,
        })
        .drop("rule_index", "fixed_severity", "description")
    )


def fired(graded: DataFrame) -> DataFrame:
    return graded.where("affected_rows > 0")


def rule_report(issues: DataFrame) -> DataFrame:
    return issues.select(
        "table_name", "column_name", "rule_name", "severity", "affected_rows", "total_rows", "affected_percentage"
    )


def issue_report(issues: DataFrame) -> DataFrame:
    return issues.select(
        "table_name", "column_name", "rule_category", "rule_name", "severity", "affected_rows", "total_rows",
        "affected_percentage", "issue_description", "business_impact", "recommended_action", "remediation_sql",
        "risk_level", "confidence",
    )


def issue_list(
    issues: DataFrame,
    severities: Sequence[str] = ("CRITICAL", "HIGH", "MEDIUM"),
    categories: Sequence[str] = (),
) -> DataFrame:
    """The report's issue grid: chosen severities and, if any are given, categories."""
    chosen = issues.where(F.col("severity").isin(*severities))
    if categories:
        chosen = chosen.where(F.col("rule_category").isin(*categories))
    return chosen.select(
        F.col("severity").alias("Severity"), F.col("column_name").alias("Column"),
        F.col("rule_category").alias("Category"), F.col("rule_name").alias("Rule"),
        F.col("affected_rows").alias("Rows"), F.col("affected_percentage").alias("%"),
        F.col("issue_description").alias("Description"),
    )


def issue_categories(issues: DataFrame) -> DataFrame:
    return issues.select("rule_category").distinct()


def top_critical(issues: DataFrame, n: int = 5) -> DataFrame:
    """The first critical or high issues in report order."""
    return issues.where(F.col("severity").isin("CRITICAL", "HIGH")).orderBy(*REPORT_ORDER).limit(n)


def issues_by_severity(issues: DataFrame) -> DataFrame:
    return (
        issues.groupBy("table_name", "severity")
        .agg(F.count(F.lit(1)).alias("issues"))
        .withColumn("severity_rank", severity_rank(F.col("severity")))
        .orderBy("table_name", "severity_rank")
    )


def is_fixable() -> Column:
    """True where the remediation is a statement that changes data."""
    text = F.trim(F.col("remediation_sql"))
    return (text != "") & ~text.startswith("--") & ~F.upper(text).startswith("SELECT")


def fix_queue(issues: DataFrame) -> DataFrame:
    """The fixable issues; `is_safe` marks those with low risk."""
    return issues.where(is_fixable()).withColumn("is_safe", F.col("risk_level") == "LOW")


def fix_summary(issues: DataFrame) -> DataFrame:
    safe = is_fixable() & (F.col("risk_level") == "LOW")
    return issues.agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(is_fixable()).alias("fixable"),
        F.count_if(safe).alias("low_risk"),
    )


def with_catalog(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues of the active catalog rules whose type list covers the column; severity is the catalog's."""
    active = rules.where("is_active").select(
        F.col("rule_name").alias("catalog_rule"), "severity_default", "applicable_data_types"
    )
    listed = F.array_contains(F.split("applicable_data_types", ","), F.col("type_family"))
    return (
        issues.join(F.broadcast(active), "catalog_rule")
        .where(F.col("type_family").isNull() | listed)
        .withColumn("severity", F.col("severity_default"))
        .drop("severity_default", "applicable_data_types")
    )
