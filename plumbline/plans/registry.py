"""Every operator as a query over the driver's tables: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.binding import col
from plumbline.config import AS_OF, SCANNED, open_workspace
from plumbline.functions.numbers import dimension_band, health_band
from plumbline.functions.predicates import moment
from plumbline.operators import (
    contracts, fixes, history, issues as issue_ops, profile, records, risk, scoring, violations,
)
from plumbline.operators.keyed import duplicate_key_groups
from plumbline.plans import cycle, report
from plumbline.plans.scan import Scan, Workspace, compile_catalog, scan
from plumbline.rules import DIMENSIONS
from plumbline.schemas import RULE_PREDICATES
from plumbline.sources import generators, seed
from plumbline.sources.defects import dirty_events
from plumbline.sources.store import Store, shared_folder
from plumbline.sources.tables import row_counts, sample_rows, stored_tables
from plumbline.sources.values import literal_rows
from plumbline.streaming import monitors

Query = Callable[[SparkSession, str], DataFrame]
APPROVER = "steward"
# The date that places a row of a fact table in its period.
DATED = {"orders_dirty": "order_date", "lineitem": "l_shipdate"}

# The contracts of the demo, with a switched-off one and some that cannot be evaluated.
CONTRACTS = (
    contracts.contract(1, "orders_dirty", "Order quantity must be positive",
                       "quantity <= 0", "HIGH", dt.datetime(2024, 5, 1, 9)),
    contracts.contract(2, "customer_dirty", "Every customer has an e-mail address",
                       "email IS NULL OR trim(email) = ''", "MEDIUM", dt.datetime(2024, 5, 2, 9)),
    contracts.contract(3, "part_dirty", "Products sell above cost",
                       "cost_price >= unit_price", "HIGH", dt.datetime(2024, 5, 3, 9)),
    contracts.contract(4, "orders_dirty", "Orders arrive within thirty days",
                       "delivery_date > order_date + INTERVAL '30' DAY", "LOW", dt.datetime(2024, 5, 4, 9)),
    contracts.contract(5, "lineitem", "Line numbers start at one",
                       "l_linenumber < 1", "LOW", dt.datetime(2024, 5, 5, 9)),
    contracts.contract(6, "lineitem", "Discounts stay below ten percent",
                       "l_discount >= 0.1", "MEDIUM", dt.datetime(2024, 5, 6, 9)),
    contracts.contract(7, "orders_dirty", "Retired: orders have a status",
                       "order_status IS NULL", "LOW", dt.datetime(2024, 5, 7, 9), is_active=False),
    contracts.contract(8, "orders_dirty", "Refers to a column that is gone",
                       "no_such_column > 1", "LOW", dt.datetime(2024, 5, 8, 9)),
    contracts.contract(9, "orders_dirty", "Carries a comment",
                       "quantity <= 0 -- zero counts too", "LOW", dt.datetime(2024, 5, 9, 9)),
    contracts.contract(10, "orders_dirty", "Counts rows instead of testing one",
                       "count(1) > 0", "LOW", dt.datetime(2024, 5, 10, 9)),
    contracts.contract(11, "orders_dirty", "Looks at other rows",
                       "row_number() OVER (ORDER BY order_id) > 1", "LOW", dt.datetime(2024, 5, 11, 9)),
    contracts.contract(12, "orders_dirty", "Divides by zero",
                       "10 / (quantity - quantity) > 1", "LOW", dt.datetime(2024, 5, 12, 9)),
)


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison with other engines."""
    return df.select(*[
        col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else col(f.name)
        for f in df.schema.fields
    ])


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _full_scan(spark: SparkSession, directory: str) -> Scan:
    return scan(open_workspace(spark, directory), SCANNED)


def on_scan(build: Callable[[Scan], DataFrame]) -> Query:
    return lambda spark, directory: build(_full_scan(spark, directory))


def on_workspace(build: Callable[[Workspace], DataFrame]) -> Query:
    return lambda spark, directory: build(open_workspace(spark, directory))


def on_history(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: build(data_history(open_workspace(spark, directory)))


def _rule(name: str, tables: Sequence[str] = SCANNED) -> Query:
    return on_workspace(lambda ws: issue_ops.rule_report(scan(ws, tables, {name}).issues))


def _fix(table: str, rule_name: str, columns: Sequence[str]) -> Query:
    """The whole table's key and fixed columns after the fix."""

    def build(ws: Workspace) -> DataFrame:
        chosen = fixes.choose(ws.bound([table]), rule_name)
        fixed = fixes.apply_fixes(ws.tables[table], chosen)
        return _plain(fixed.select(*ws.key(table), *columns))

    return on_workspace(build)


def periodic_scan(ws: Workspace, tables: Sequence[str], unit: str) -> Scan:
    """The fact tables scanned period by period ("month", "year"), each period by itself."""
    return scan(ws, tables, period={t: F.trunc(col(DATED[t]), unit) for t in tables})


def past_scores(ws: Workspace, unit: str) -> DataFrame:
    """Scores of a history that holds every row of every scanned table in one scan.

    Rows of the past belong to the scan of their period. Rows dated later than `as_of`, rows without
    a date and tables without a date column belong to the scan of `as_of` itself.
    """
    today = moment(ws.as_of).cast("date")

    def scanned_on(table: str) -> Column:
        if table not in DATED:
            return today
        date = col(DATED[table])
        return F.coalesce(F.when(date <= moment(ws.as_of), F.trunc(date, unit)), today)

    return scan(ws, SCANNED, period={t: scanned_on(t) for t in SCANNED}).scores


def data_history(ws: Workspace) -> DataFrame:
    """A score history made from the data: one scan per table and year, and one of today."""
    day = F.col("scan_date")
    rows = history.history_rows(
        past_scores(ws, "year"), records.scan_id(day), day, day, cycle.DATABASE, cycle.SCHEMA)
    return rows.select(*history.HISTORY_COLUMNS)


def _scan_rows(ws: Workspace, scores: DataFrame, at: Column) -> DataFrame:
    widths = {name: len(ws.tables[name].columns) for name in SCANNED}
    return records.scan_result_rows(scores, widths, cycle.DATABASE, cycle.SCHEMA, at)


def _ids(ws: Workspace, table: str, key: str) -> DataFrame:
    return ws.tables[table].select((col(key) + 1).cast("long").alias("id"))


def _generated_orders(ws: Workspace) -> DataFrame:
    # Row counts come from file footers.
    return generators.orders(
        _ids(ws, "orders", "o_orderkey"), AS_OF, ws.tables["customer"].count(), ws.tables["part"].count())


def _by_table(build: Callable[[DataFrame, str], DataFrame]) -> Query:
    return on_workspace(lambda ws: _union([build(ws.tables[name], name) for name in SCANNED]))


def _duplicates(ws: Workspace) -> DataFrame:
    return _union([
        duplicate_key_groups(ws.tables[name], ws.key(name)).select(
            F.lit(name).alias("table_name"),
            F.concat_ws(", ", *[col(c).cast("string") for c in ws.key(name)]).alias("key_value"), "n_rows",
        )
        for name in SCANNED if ws.key(name)
    ])


def _orphans(ws: Workspace) -> DataFrame:
    """The rows behind every bound reference, by the key of their table."""
    found = []
    for name in SCANNED:
        for fk in ws.binding(name).foreign_keys:
            rows = violations.orphan_rows(ws.tables[name], fk, ws.tables[fk.parent_table], ws.key(name))
            key = F.concat_ws(", ", *[col(c).cast("string") for c in ws.key(name)])
            found.append(rows.select(F.lit(name).alias("table_name"), F.lit(fk.column).alias("column_name"),
                                     key.alias("key_value"), col(fk.column).cast("string").alias("reference")))
    return _union(found)


def _statements(ws: Workspace) -> list[tuple]:
    """Every bound rule's remediation, as it is printed."""
    return [(b, text) for b in ws.bound(SCANNED)
            if (text := b.text(b.rule.remediation)) and not text.startswith("--")]


def _counted(ws: Workspace, wanted: list[tuple]) -> DataFrame:
    """Runs SELECT statements as a user would, each over the tables it names."""
    names = {t for b, _ in wanted for t in (b.table, *(fk.parent_table for fk in ws.binding(b.table).foreign_keys))}
    for name in names:
        ws.tables[name].createOrReplaceTempView(name)
    try:
        return _union([
            ws.spark.sql(statement).agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(b.table).alias("table_name"), F.lit(b.column).alias("column_name"),
                F.lit(b.rule.name).alias("rule_name"), "n_rows")
            for b, statement in wanted])
    finally:
        for name in names:
            ws.spark.catalog.dropTempView(name)


def _remediation_selects(ws: Workspace) -> DataFrame:
    """How many rows each printed SELECT returns."""
    return _counted(ws, [(b, text) for b, text in _statements(ws) if text.startswith("SELECT")])


def _remediation_where(ws: Workspace) -> DataFrame:
    """How many rows each printed UPDATE would change."""
    updates = [(b, text) for b, text in _statements(ws) if text.startswith("UPDATE")]
    return _counted(ws, [(b, f"SELECT 1 FROM {b.table} WHERE {text.split(' WHERE ', 1)[1]}") for b, text in updates])


def _losses(ws: Workspace) -> DataFrame:
    rule = ws.bound(["part_dirty"], {"COST_EXCEEDS_PRICE"})[0]
    return violations.failing_rows(ws.tables["part_dirty"], rule).select(
        "product_id", "product_name", "cost_price", "unit_price")


def _catalog_scan(ws: Workspace) -> DataFrame:
    found = scan(ws, (*SCANNED, "events"), "catalog").issues
    rules = seed.rule_catalog(ws.spark, dt.datetime(2024, 1, 1))
    return issue_ops.with_catalog(found, rules).select(
        "table_name", "column_name", "catalog_rule", "rule_name", "rule_category", "severity", "affected_rows",
        "total_rows", "affected_percentage",
    )


# Rules that a user added to the catalog, and what they look for.
OWN_RULES = (("BULK_ORDER", "VALIDITY", "Orders of more than 45 pieces", "NUMBER", "LOW"),
             ("RETIRED_RULE", "VALIDITY", "Not looked at any more", "NUMBER", "LOW"))
OWN_PREDICATES = (("BULK_ORDER", "orders_dirty", "quantity", "quantity > 45"), ("RETIRED_RULE", "orders_dirty", "quantity", "quantity > 1"),
                  ("BULK_ORDER", "part_dirty", "unit_price", "no_such_column > 1"))


def _active_scan(ws: Workspace) -> DataFrame:
    """The issues of the rules that the stored catalog switches on, its own ones included."""
    catalog = seed.rule_catalog(ws.spark, dt.datetime(2024, 1, 1), ("PHONE_FORMAT", "WHITESPACE_CHECK", "RETIRED_RULE"), OWN_RULES)
    predicates = literal_rows(ws.spark, RULE_PREDICATES, OWN_PREDICATES)
    tables = ("customer_dirty", "orders_dirty", "part_dirty")
    names, own = compile_catalog(ws, catalog, predicates, tables)
    return issue_ops.with_catalog(scan(ws, tables, names, own=own).issues, catalog).select(
        "table_name", "column_name", "catalog_rule", "rule_name", "severity", "affected_rows", "total_rows", "affected_percentage")


def _bands(done: Scan) -> DataFrame:
    scores = done.scores
    rows = [F.struct(
        F.lit("HEALTH").alias("dimension"), F.col("health_score").alias("score"),
        health_band(F.col("health_score")).alias("band"),
    )]
    for dimension in DIMENSIONS:
        score = F.col(scoring.score_column(dimension))
        rows.append(F.struct(
            F.lit(dimension).alias("dimension"), score.alias("score"), dimension_band(score).alias("band")))
    return scores.select("table_name", F.inline(F.array(*rows)))


def _contracts_eval(ws: Workspace) -> DataFrame:
    return contracts.evaluate(contracts.contract_table(ws.spark, CONTRACTS), ws.tables)


def _contracts_active(ws: Workspace) -> DataFrame:
    table = contracts.contract_table(ws.spark, CONTRACTS)
    found = contracts.evaluate(table, ws.tables).select("contract_id", "violations")
    return contracts.active_contracts(table).join(found, "contract_id").select(
        "contract_id", "table_name", "natural_language_rule", "generated_sql_check", "severity", "created_at",
        "violations",
    ).orderBy(F.desc("created_at"), F.desc("contract_id"))


def _rollback(ws: Workspace) -> DataFrame:
    """Fix a table as a new snapshot, then go back to the one before."""
    store = Store(ws.spark, shared_folder(ws.spark, "rollback"))
    original = store.write_snapshot("customer_dirty", "v1", ws.tables["customer_dirty"])
    store.write_snapshot("customer_dirty", "v2", fixes.apply_fixes(
        original, fixes.safe_rules(ws.bound(["customer_dirty"]))))
    versions = [("original", "v1"), ("fixed", "v2"), ("restored", "v1")]
    trimmed = F.trim(F.col("name"))
    return _union([
        store.read_snapshot("customer_dirty", folder).select(
            F.lit(name).alias("version"), "customer_id", "name", "email", "segment",
            (F.col("name") != trimmed).alias("is_padded"))
        for name, folder in versions])


def _remediations(ws: Workspace) -> DataFrame:
    return cycle.remediation_log(ws, SCANNED, APPROVER)


def _round(ws: Workspace) -> DataFrame:
    """A round of scans and fixes, read back from the tables that it wrote."""
    store = Store(ws.spark, shared_folder(ws.spark, "round"))
    at = dt.datetime.combine(AS_OF, dt.time())
    cycle.run_cycle(ws, SCANNED, store, APPROVER, at)
    results, later = store.read("scan_results"), F.col("scan_timestamp") > moment(at)

    def of(phase: Column, column: str) -> Column:
        return F.max(F.when(phase, F.col(column).cast("double" if column == "health_score" else "bigint")))

    scores = results.groupBy("table_name").agg(
        of(~later, "health_score").alias("score_before"), of(later, "health_score").alias("score_after"),
        of(~later, "issues_found").alias("issues_before"), of(later, "issues_found").alias("issues_after"))
    for name, count in (("scan_issues", "issue_rows"), ("health_score_history", "history_rows"), ("remediation_log", "fixes")):
        counted = store.read(name).groupBy("table_name").agg(F.count(F.lit(1)).alias(count))
        scores = scores.join(F.broadcast(counted), "table_name", "left")  # a row for each table
    return scores.na.fill(0, ["issue_rows", "history_rows", "fixes"])


def _images(ws: Workspace) -> DataFrame:
    """How many rows each safe fix changes, and how many of them it leaves empty."""
    made = _union([fixes.fix_images(ws.tables[name], name, ws.key(name), fixes.safe_rules(ws.bound([name]))) for name in SCANNED])
    emptied = F.exists("changes", lambda c: c["new_value"].isNull())
    return made.groupBy("table_name", "rule_name", "column_name").agg(
        F.count(F.lit(1)).alias("changed_rows"), F.count_if(emptied).alias("emptied_rows"))


def _undone(ws: Workspace) -> DataFrame:
    """The customers with all safe fixes but the trimming of names."""
    key, rules = ws.key("customer_dirty"), fixes.safe_rules(ws.bound(["customer_dirty"]))
    fixed = fixes.apply_fixes(ws.tables["customer_dirty"], rules)
    images = fixes.fix_images(ws.tables["customer_dirty"], "customer_dirty", key, rules)
    return fixes.undo(fixed, images, key, "WHITESPACE", "name").select(*key, "name", "email", "segment")


def _explained(done: Scan) -> DataFrame:
    return report.explanations(done.issues)


def _context(ws: Workspace) -> DataFrame:
    return report.context_summary(scan(ws, SCANNED).issues, data_history(ws))


def _at_risk(ws: Workspace) -> DataFrame:
    return _union([
        risk.distinct_rows_at_risk(ws.tables[name], name, ws.bound([name]), ws.tables) for name in SCANNED
    ])


def _health_by_month(ws: Workspace) -> DataFrame:
    scored = periodic_scan(ws, ["orders_dirty"], "month").scores
    return history.changes_over_time(scored).select(
        "table_name", "scan_date", "total_rows", "issues_found", "rows_at_risk", "health_score", "previous_score",
        "change",
    )


def _event_stream(ws: Workspace) -> DataFrame:
    """The dirty events arriving as files, a batch each; copies of a row are in different batches."""
    dirty = dirty_events(ws.tables["events"])
    folder = monitors.landed(dirty, shared_folder(ws.spark, "landed"), "events")
    return monitors.read_stream(ws.spark, folder, "events", dirty.schema, files_per_batch=1)


def _stream_rule_counts(ws: Workspace) -> DataFrame:
    rules = ws.bound(["events_dirty"])
    timed = _event_stream(ws).withColumn(monitors.EVENT_TIME, monitors.event_time("ts"))
    kept = monitors.run_window_counts(timed, rules, shared_folder(ws.spark, "stream-rule-counts"))
    named = issue_ops.grade(kept, issue_ops.rule_table(ws.spark, rules))
    return named.select("window_start", "column_name", "rule_name", "affected_rows", "total_rows")


def _stream_dedup(ws: Workspace) -> DataFrame:
    return monitors.run_first_occurrences(_event_stream(ws), ["event_id"], shared_folder(ws.spark, "stream-dedup"))


def _stream_orphans(ws: Workspace) -> DataFrame:
    fk = ws.binding("events_dirty").foreign_keys[0]
    arriving = _event_stream(ws).select("event_id", "user_id", "ts")
    return monitors.run_orphans(
        arriving, fk, ws.tables[fk.parent_table], ["event_id"], shared_folder(ws.spark, "stream-orphans"))


def _stream_health(ws: Workspace) -> DataFrame:
    """The health of the whole table after the last of its batches."""
    kept = monitors.run_health(ws, "events_dirty", _event_stream(ws), shared_folder(ws.spark, "stream-health"), moment(AS_OF))
    return kept.orderBy(F.desc("batch_id")).limit(1).select(
        "scan_id", "scan_date", "table_name", "health_score", *history.SCORE_COLUMNS, "total_issues",
        "critical_issues", "rows_at_risk",
    )


QUERIES: dict[str, Query] = {
    # tables and generated data
    "table_row_counts": lambda spark, d: row_counts(stored_tables(spark, d)),
    "sample_rows": on_workspace(lambda ws: _plain(sample_rows(ws.tables["orders_dirty"], ["order_id"]))),
    "gen_dim_values": on_workspace(lambda ws: generators.dimension_usage(_ids(ws, "customer", "c_custkey"))),
    "gen_customers": on_workspace(
        lambda ws: _plain(generators.customers(_ids(ws, "customer", "c_custkey"), AS_OF))),
    "gen_products": on_workspace(lambda ws: _plain(generators.products(_ids(ws, "part", "p_partkey"), AS_OF))),
    "gen_orders": on_workspace(lambda ws: _plain(_generated_orders(ws))),
    "inject_defects_customer": on_workspace(lambda ws: ws.tables["customer_dirty"]),
    "inject_defects_orders": on_workspace(lambda ws: _plain(ws.tables["orders_dirty"])),
    "inject_defects_part": on_workspace(lambda ws: ws.tables["part_dirty"]),
    # profiles
    "profile_columns": _by_table(profile.profile_columns),
    "profile_numeric": _by_table(profile.profile_numeric),
    "profile_text": _by_table(profile.profile_text),
    "profile_top_values": _by_table(profile.top_values),
    # rules that run
    "rule_null_check": _rule("NULL_CHECK"),
    "rule_blank_string": _rule("BLANK_STRING"),
    "rule_duplicate_key": _rule("DUPLICATE_KEY"),
    "rule_email_format": _rule("EMAIL_FORMAT"),
    "rule_negative_value": _rule("NEGATIVE_VALUE"),
    "rule_future_date": _rule("FUTURE_DATE"),
    "rule_invalid_category": _rule("INVALID_CATEGORY"),
    "rule_whitespace": _rule("WHITESPACE"),
    "rule_orphan_reference": _rule("ORPHAN_REFERENCE"),
    "rule_date_ordering": _rule("DATE_ORDERING"),
    "rule_amount_mismatch": _rule("AMOUNT_MISMATCH"),
    "rule_cost_exceeds_price": _rule("COST_EXCEEDS_PRICE"),
    # rules declared in the catalog
    "rule_duplicate_row": _rule("DUPLICATE_ROW"),
    "rule_phone_format": _rule("PHONE_FORMAT"),
    "rule_date_range": _rule("DATE_RANGE"),
    "rule_numeric_range": _rule("NUMERIC_RANGE"),
    "rule_case_consistency": _rule("CASE_CONSISTENCY"),
    "rule_freshness": _rule("FRESHNESS_CHECK", ("events",)),
    "rule_outlier_iqr": _rule("OUTLIER_DETECTION", ("events",)),
    # offending rows
    "violations_duplicates": on_workspace(_duplicates),
    "violations_orphans": on_workspace(_orphans),
    "remediation_selects": on_workspace(_remediation_selects),
    "remediation_where": on_workspace(_remediation_where),
    "violations_cost": on_workspace(_losses),
    # scans, issues, scores
    "scan_issues": on_scan(lambda done: issue_ops.issue_report(done.issues)),
    "scan_issues_catalog": on_workspace(_catalog_scan),
    "scan_issues_active": on_workspace(_active_scan),
    "scan_results": on_scan(lambda done: _scan_rows(done.workspace, done.scores, moment(AS_OF))
                            .drop("scan_timestamp")),
    "history_row": on_scan(lambda done: records.scan_history_rows(
        done.scores, cycle.DATABASE, cycle.SCHEMA, moment(AS_OF)).drop("recorded_at")),
    "dimension_scores": on_scan(lambda done: scoring.dimension_scores(done.scores)),
    "health_score": on_scan(lambda done: done.scores.select(
        "table_name", "health_score", F.col("issues_found").alias("issues"))),
    "score_band": on_scan(_bands),
    "rows_at_risk_distinct": on_workspace(_at_risk),
    "issue_list": on_scan(lambda done: issue_ops.issue_list(done.issues)),
    "issue_list_filtered": on_scan(lambda done: issue_ops.issue_list(
        done.issues, ("CRITICAL", "HIGH"), ("VALIDITY", "INTEGRITY"))),
    "issue_categories": on_scan(lambda done: issue_ops.issue_categories(done.issues)),
    "issues_by_severity": on_scan(lambda done: issue_ops.issues_by_severity(done.issues)),
    "top_critical": on_scan(lambda done: issue_ops.rule_report(issue_ops.top_critical(done.issues))),
    "issue_explanations": on_scan(_explained),
    "guardian_context": on_workspace(_context),
    # fixes
    "fix_queue": on_scan(lambda done: issue_ops.fix_queue(done.issues).select(
        "table_name", "column_name", "rule_name", "severity", "affected_rows", "risk_level", "confidence",
        "remediation_sql", "is_safe")),
    "fix_summary": on_scan(lambda done: issue_ops.fix_summary(done.issues)),
    "fix_blank_string": _fix("customer_dirty", "BLANK_STRING", ["name", "email", "phone", "segment"]),
    "fix_email": _fix("customer_dirty", "EMAIL_FORMAT", ["email"]),
    "fix_negative": _fix("orders_dirty", "NEGATIVE_VALUE", ["quantity", "unit_price", "total_amount"]),
    "fix_future_date": _fix("orders_dirty", "FUTURE_DATE", ["order_date"]),
    "fix_invalid_category": _fix("customer_dirty", "INVALID_CATEGORY", ["segment"]),
    "fix_whitespace": _fix("customer_dirty", "WHITESPACE", ["name", "email", "phone", "segment"]),
    "fix_date_swap": _fix("orders_dirty", "DATE_ORDERING", ["order_date", "delivery_date"]),
    "fix_amount": _fix("orders_dirty", "AMOUNT_MISMATCH", ["total_amount"]),
    "fix_one": on_workspace(lambda ws: cycle.approve(
        ws, "customer_dirty", "FUTURE_DATE", ["date_of_birth"], APPROVER)[0].select("customer_id", "date_of_birth")),
    "fix_one_log": on_workspace(lambda ws: cycle.approve(
        ws, "customer_dirty", "FUTURE_DATE", ["date_of_birth"], APPROVER)[1]),
    "fix_dedup": on_workspace(lambda ws: _plain(
        fixes.deduplicate(ws.tables["orders_dirty"], ["order_id"], ["order_date"]))),
    "fix_rollback": on_workspace(_rollback),
    "remediation_log": on_workspace(_remediations),
    "before_after": on_workspace(lambda ws: cycle.before_after(ws, SCANNED)),
    "run_cycle": on_workspace(_round),
    "fix_images": on_workspace(_images),
    "fix_undo": on_workspace(_undone),
    # history
    "health_by_month": on_workspace(_health_by_month),
    "history_latest": on_history(history.latest),
    "history_latest_per_table": on_history(history.latest_per_table),
    "history_trend": on_history(history.trend),
    "history_by_table": on_history(lambda rows: rows.orderBy("scan_date", "table_name")),
    "health_latest": on_history(lambda rows: history.kpis(rows).select("health_score")),
    "overview_kpis": on_history(history.kpis),
    "overview_dimensions": on_history(history.mean_dimensions),
    "issues_by_table": on_history(
        lambda rows: history.latest(rows).select("table_name", "total_issues", "critical_issues")),
    "trust_delta": on_history(history.trust_delta),
    "trust_change": on_history(history.trust_change),
    "audit_scans": on_workspace(lambda ws: records.newest_scans(
        _scan_rows(ws, past_scores(ws, "month"), F.col("scan_date")))),
    "audit_remediations": on_workspace(lambda ws: records.newest_remediations(_remediations(ws))),
    # contracts
    "contracts_eval": on_workspace(_contracts_eval),
    "contracts_active": on_workspace(_contracts_active),
    # streams
    "stream_rule_counts": on_workspace(_stream_rule_counts),
    "stream_dedup": on_workspace(_stream_dedup),
    "stream_orphans": on_workspace(_stream_orphans),
    "stream_health": on_workspace(_stream_health),
}
