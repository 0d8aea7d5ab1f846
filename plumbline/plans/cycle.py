"""The whole round: scan, score, fix what is safe, scan again, compare."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from plumbline import schemas
from plumbline.functions.predicates import moment
from plumbline.operators import records
from plumbline.operators.fixes import apply_fixes, choose, failure, fix_images, safe_rules
from plumbline.operators.issues import fix_queue
from plumbline.plans.scan import AFTER, BEFORE, Scan, Workspace, scan, scan_before_after
from plumbline.sources.store import Round, Store, settle
from plumbline.sources.values import literal_rows

DATABASE, SCHEMA = "warehouse", "quality"


def safe_issues(issues: DataFrame) -> DataFrame:
    return fix_queue(issues).where("is_safe")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Scores and issues of each table before and after."""
    return before.select(
        "table_name", F.col("health_score").alias("score_before"), F.col("issues_found").alias("issues_before")
    ).join(
        after.select(
            "table_name", F.col("health_score").alias("score_after"), F.col("issues_found").alias("issues_after")),
        "table_name",
    )


def _compared(both: Scan) -> DataFrame:
    """The comparison of a scan that counted both phases."""

    def of(phase, column):
        return F.max(F.when(F.col("phase") == phase, F.col(column)))

    return both.scores.groupBy("table_name").agg(
        of(BEFORE, "health_score").alias("score_before"), of(AFTER, "health_score").alias("score_after"),
        of(BEFORE, "issues_found").alias("issues_before"), of(AFTER, "issues_found").alias("issues_after"),
    )


def _counted(both: Scan) -> Scan:
    """A scan whose counters are written once, for when several results are made from them."""
    return Scan(both.workspace, both.rules, settle(both.counts, "counters"), both.by)


def before_after(ws: Workspace, names: Sequence[str]) -> DataFrame:
    """What the safe fixes would change, without writing anything."""
    return _compared(scan_before_after(ws, names))


def remediation_log(ws: Workspace, names: Sequence[str], approved_by: str) -> DataFrame:
    """The log rows of the safe fixes as a preview: nothing is run, and the rows say so."""
    both = _counted(scan_before_after(ws, names))
    found = both.issues.where(F.col("phase") == BEFORE)
    return records.remediation_rows(safe_issues(found), _compared(both), ws.as_of, approved_by)


def approve(
    ws: Workspace, name: str, rule_name: str, columns: Sequence[str], approved_by: str
) -> tuple[DataFrame, DataFrame]:
    """One fix, whatever its risk: the fixed table and the log rows."""
    chosen = choose(ws.bound([name]), rule_name, columns)
    both = _counted(scan_before_after(ws, [name], lambda bound: choose(bound, rule_name, columns)))
    approved = both.issues.where(
        (F.col("phase") == BEFORE) & (F.col("rule_name") == rule_name)
        & F.col("column_name").isin([b.column for b in chosen])
    )
    log = records.remediation_rows(approved, _compared(both), ws.as_of, approved_by, records.APPROVED)
    return apply_fixes(ws.tables[name], chosen), log


def save_scan(done: Scan, kept: Round, at: dt.datetime) -> Scan:
    """Adds a scan to a round: its counters once, then result, history and issue rows made from them."""
    ws, now = done.workspace, moment(at)
    written = Scan(ws, done.rules, kept.put("counters", done.counts), done.by)
    scores = written.scores
    names = sorted({b.table for b in done.rules})
    widths = {name: len(ws.tables[name].columns) for name in names}
    kept.put("scan_results", records.conform(
        records.scan_result_rows(scores, widths, DATABASE, SCHEMA, now), schemas.SCAN_RESULTS))
    kept.put("health_score_history", records.conform(
        records.scan_history_rows(scores, DATABASE, SCHEMA, now), schemas.HEALTH_SCORE_HISTORY), by="scan_date")
    kept.put("scan_issues", records.conform(records.issue_rows(written.issues, now), schemas.SCAN_ISSUES))
    return written


def _apply(ws: Workspace, name: str, kept: Round) -> tuple[DataFrame, list[tuple]]:
    """Adds a table with its safe fixes, and what each changed, to a round. A fix that fails is left out; its
    error is returned as a row of `records.EFFECTS`."""
    df, rules, failed = ws.tables[name], safe_rules(ws.bound([name])), []
    try:
        fixed = kept.put(f"fixed_{name}", apply_fixes(df, rules))
    except PySparkException:
        errors = [failure(df, b) for b in rules]
        if not any(errors):
            raise
        failed = [(name, b.rule.name, b.column, 0, error) for b, error in zip(rules, errors, strict=True) if error]
        rules = [b for b, error in zip(rules, errors, strict=True) if not error]
        fixed = kept.put(f"fixed_{name}", apply_fixes(df, rules))
    kept.put("fix_images", records.conform(fix_images(df, name, ws.key(name), rules), schemas.FIX_IMAGES))
    return fixed, failed


def run_cycle(ws: Workspace, names: Sequence[str], store: Store, approved_by: str, at: dt.datetime) -> DataFrame:
    """Scan, apply the safe fixes, log what they did, scan again; the comparison.

    Results, issues, history, log, images and fixed tables are one commit: a round that was cut short
    leaves nothing behind that is read, and running it again with the same `at` replaces what it wrote.
    """
    kept = store.round(f"{at:%Y%m%d_%H%M%S}")
    before = save_scan(scan(ws, names), kept, at)
    snapshots, failed = {}, []
    for name in names:
        snapshots[name], errors = _apply(ws, name, kept)
        failed += errors
    after = save_scan(scan(ws.replacing(snapshots), names), kept, at + dt.timedelta(seconds=1))
    compared = compare(before.scores, after.scores)
    images = ws.spark.read.schema(schemas.FIX_IMAGES).parquet(*kept.tables["fix_images"])
    effects = images.groupBy("table_name", "rule_name", "column_name").agg(
        F.count(F.lit(1)).alias("changed_rows")).withColumn("error", F.lit(None).cast("string"))
    if failed:
        effects = effects.unionByName(literal_rows(ws.spark, records.EFFECTS, failed))
    kept.put("remediation_log", records.conform(
        records.remediation_rows(safe_issues(before.issues), compared, at, approved_by, effects=effects), schemas.REMEDIATION_LOG))
    kept.commit()
    return compared
