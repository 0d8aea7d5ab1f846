"""Oracles of scans, scores, reports, history, contracts and stream counts."""

from __future__ import annotations

from oracles.scans import (
    COLUMNS, EVENT_SELECTS, SCANNED, count_selects, graded, row_rules, scores, selects_of,
)
from oracles.views import with_views

DIMENSIONS = ("COMPLETENESS", "UNIQUENESS", "VALIDITY", "CONSISTENCY", "INTEGRITY", "FRESHNESS")
SCORE_COLUMNS = [f"{d.lower()}_score" for d in DIMENSIONS]
SCORES_AS_DOUBLE = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SCORE_COLUMNS)
HEALTH = "CAST(health_score AS DOUBLE) AS health_score"
REPORT = "table_name, column_name, rule_name, severity, n AS affected_rows, total AS total_rows, pct AS affected_percentage"
SCAN = graded(selects_of(SCANNED))
SCORED = scores()
FIXABLE = "fix <> '' AND NOT starts_with(trim(fix, ' '), '--') AND NOT starts_with(upper(trim(fix, ' ')), 'SELECT')"
ID = "'SCAN_20240601_000000_' || table_name"


def on_scan(query: str, *ctes: str) -> str:
    return with_views(query, SCAN, *ctes)


def on_scores(query: str, *ctes: str) -> str:
    return with_views(query, SCAN, SCORED, *ctes)


def rule(name: str, declared: bool = False) -> str:
    selects = selects_of(SCANNED, names={name}, declared=declared)
    return with_views(f"SELECT {REPORT} FROM graded WHERE n > 0", graded(selects))


def event_rule(select: str) -> str:
    return with_views(f"SELECT {REPORT} FROM graded WHERE n > 0", graded([select]))


# The rule that switches each check on, its severity and types.
CATALOG = (
    ("NULL_CHECK", "NULL_CHECK", "HIGH", None), ("BLANK_STRING", "BLANK_STRING_CHECK", "MEDIUM", None),
    ("DUPLICATE_KEY", "DUPLICATE_CHECK", "CRITICAL", None), ("DUPLICATE_ROW", "DUPLICATE_ROW_CHECK", "CRITICAL", None),
    ("EMAIL_FORMAT", "EMAIL_FORMAT", "HIGH", None), ("PHONE_FORMAT", "PHONE_FORMAT", "MEDIUM", None),
    ("FUTURE_DATE", "DATE_RANGE", "HIGH", None), ("DATE_RANGE", "DATE_RANGE", "HIGH", None),
    ("NEGATIVE_VALUE", "NUMERIC_RANGE", "HIGH", None), ("NUMERIC_RANGE", "NUMERIC_RANGE", "HIGH", None),
    ("INVALID_CATEGORY", "CATEGORICAL_VALIDITY", "MEDIUM", None), ("WHITESPACE", "WHITESPACE_CHECK", "LOW", None),
    ("CASE_CONSISTENCY", "CASE_CONSISTENCY", "LOW", None), ("ORPHAN_REFERENCE", "REFERENTIAL_INTEGRITY", "CRITICAL", None),
    ("AMOUNT_MISMATCH", "AMOUNT_CONSISTENCY", "HIGH", None), ("DATE_ORDERING", "DATE_ORDERING", "HIGH", None),
    ("FRESHNESS_CHECK", "FRESHNESS_CHECK", "MEDIUM", None), ("OUTLIER_DETECTION", "OUTLIER_DETECTION", "MEDIUM", None),
)


def catalog_scan() -> str:
    mapping = ", ".join(f"('{a}', '{b}', '{s}')" for a, b, s, _ in CATALOG)
    event_nulls = [
        f"SELECT 'events' AS table_name, '{c}' AS column_name, 'NULL_CHECK' AS rule_name, 1 AS rule_seq, 0 AS ordinal, "
        f"'COMPLETENESS' AS rule_category, '' AS fixed, 'MEDIUM' AS risk_level, CAST(99.9 AS DOUBLE) AS confidence, "
        f"'' AS d, '' AS impact, '' AS action, '' AS fix, count(*) FILTER (WHERE {c} IS NULL) AS n, "
        f"CAST(0 AS BIGINT) AS g, count(*) AS total FROM events"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")]
    selects = selects_of(SCANNED, declared=True) + EVENT_SELECTS + event_nulls
    return with_views(
        "SELECT g.table_name, g.column_name, m.c AS catalog_rule, g.rule_name, g.rule_category, m.s AS severity, "
        "g.n AS affected_rows, g.total AS total_rows, g.pct AS affected_percentage FROM graded g "
        f"JOIN (VALUES {mapping}) m(r, c, s) ON m.r = g.rule_name WHERE g.n > 0", graded(selects))


def active_scan() -> str:
    """Without two rules that are switched off, and with one that only the catalog knows."""
    tables = ("customer_dirty", "orders_dirty", "part_dirty")
    mapping = ", ".join(f"('{a}', '{b}', '{s}')" for a, b, s, _ in CATALOG if a not in ("PHONE_FORMAT", "WHITESPACE"))
    bulk = "count(*) FILTER (WHERE quantity > 45)"
    return with_views(
        "SELECT g.table_name, g.column_name, m.c AS catalog_rule, g.rule_name, m.s AS severity, g.n AS affected_rows, "
        "g.total AS total_rows, g.pct AS affected_percentage FROM graded g "
        f"JOIN (VALUES {mapping}) m(r, c, s) ON m.r = g.rule_name WHERE g.n > 0 "
        "UNION ALL SELECT 'orders_dirty', 'quantity', 'BULK_ORDER', 'BULK_ORDER', 'LOW', "
        f"{bulk}, count(*), CAST(({bulk} * 20000 + count(*)) // (2 * count(*)) AS DOUBLE) / 100 FROM orders_dirty HAVING {bulk} > 0",
        graded(selects_of(tables, declared=True)))


WIDTHS = "CAST(CASE table_name " + " ".join(
    f"WHEN '{t}' THEN {len(COLUMNS[t])}" for t in SCANNED) + " END AS BIGINT)"
SCAN_COLUMNS = (
    f"'warehouse' AS database_name, 'quality' AS schema_name, table_name, total_rows, {WIDTHS} AS total_columns, "
    f"issues_found, critical_issues, high_issues, medium_issues, low_issues, {HEALTH}, {SCORES_AS_DOUBLE}, "
    "'DEEP' AS scan_type")

# -- before and after: the safe fixes as SQL, then the same rules over the fixed tables --
FIXED = """customer_fixed AS (SELECT customer_id, trim(CASE WHEN trim(name, ' ') = '' THEN NULL ELSE name END, ' ') AS name,
 trim(CASE WHEN trim(email, ' ') = '' THEN NULL ELSE email END, ' ') AS email,
 trim(CASE WHEN trim(phone, ' ') = '' THEN NULL ELSE phone END, ' ') AS phone,
 trim(CASE WHEN segment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') THEN segment END, ' ')
   AS segment, date_of_birth, account_score FROM customer_dirty),
orders_fixed AS (SELECT order_id, customer_id, order_date, delivery_date, quantity, unit_price,
 CASE WHEN abs(total_amount - quantity * unit_price) > 0.01 THEN CAST(quantity * unit_price AS DECIMAL(12,2))
   ELSE total_amount END AS total_amount,
 CASE WHEN order_status IN ('F', 'O', 'P') THEN order_status END AS order_status FROM orders_dirty),
part_fixed AS (SELECT product_id, CASE WHEN trim(product_name, ' ') = '' THEN NULL ELSE trim(product_name, ' ') END
   AS product_name,
 CASE WHEN category IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD') THEN category END AS category,
 unit_price, cost_price FROM part_dirty),
lineitem_fixed AS (SELECT * REPLACE (nullif(trim(l_returnflag, ' '), '') AS l_returnflag,
 nullif(trim(l_linestatus, ' '), '') AS l_linestatus) FROM lineitem)"""
SOURCES = {"customer_dirty": "customer_fixed", "orders_dirty": "orders_fixed", "part_dirty": "part_fixed",
           "lineitem": "lineitem_fixed"}


def fixed_selects() -> list[str]:
    """The scan of a table with its source replaced by the fixed version."""
    result = []
    for t in SCANNED:
        for s in count_selects(t):
            result.append(s.replace(f"FROM {t} t", f"FROM {SOURCES[t]} t")
                          .replace("FROM customer_dirty p", "FROM customer_fixed p"))
    return result


AFTER = graded(fixed_selects(), "graded_after")
SCORED_AFTER = scores("graded_after", name="scored_after")


def before_after(query: str) -> str:
    return with_views(query, SCAN, SCORED, FIXED, AFTER, SCORED_AFTER)


LOG = f"""SELECT 'FIX_' || {ID} || '_' || rule_name || '_' || column_name AS remediation_id, {ID} AS scan_id,
 {ID} || '_' || rule_name || '_' || column_name AS issue_id, table_name, column_name, rule_name AS issue_type,
 severity, n AS affected_rows, fix AS remediation_sql, 'PREVIEW' AS approval_status, 'steward' AS approved_by,
 TIMESTAMP '2024-06-01 00:00:00' AS approved_at, CAST(NULL AS TIMESTAMP) AS executed_at,
 'NOT RUN' AS execution_result, CAST(b.health_score AS DOUBLE) AS before_score,
 CAST(a.health_score AS DOUBLE) AS after_score, TIMESTAMP '2024-06-01 00:00:00' AS created_at
 FROM graded JOIN scored b USING (table_name) JOIN scored_after a USING (table_name)
 WHERE n > 0 AND risk_level = 'LOW' AND {FIXABLE}"""

BIRTH_FIXED = """customer_fixed AS (SELECT * REPLACE (CASE WHEN date_of_birth > DATE '2024-06-01' THEN NULL
 ELSE date_of_birth END AS date_of_birth) FROM customer_dirty)"""


def one_log() -> str:
    before = graded(count_selects("customer_dirty"))
    after = graded([s.replace("FROM customer_dirty t", "FROM customer_fixed t")
                    for s in count_selects("customer_dirty")], "graded_after")
    query = LOG.replace(f"WHERE n > 0 AND risk_level = 'LOW' AND {FIXABLE}",
                        "WHERE n > 0 AND rule_name = 'FUTURE_DATE' AND column_name = 'date_of_birth'").replace("'PREVIEW'", "'APPROVED'")
    return with_views(query, before, SCORED, BIRTH_FIXED, after, SCORED_AFTER)


# -- history: every period of the fact tables scanned by itself, all other rows today --
def periods(unit: str, *tables: str, later_today: bool = True) -> tuple[str, str]:
    selects = selects_of(tables, unit=unit, later_today=later_today)
    return graded(selects), scores(by="table_name, scan_date")


YEARS = periods("year", *SCANNED)
PERIOD_ID = "'SCAN_' || strftime(scan_date, '%Y%m%d') || '_000000_' || table_name"
HISTORY = f"""history AS (SELECT {PERIOD_ID} AS scan_id, scan_date, 'warehouse' AS database_name,
 'quality' AS schema_name, table_name, {HEALTH}, {SCORES_AS_DOUBLE}, issues_found AS total_issues, critical_issues,
 rows_at_risk, CAST(scan_date AS TIMESTAMP) AS recorded_at FROM scored)"""
LATEST = "latest AS (SELECT * FROM history WHERE scan_date = (SELECT max(scan_date) FROM history))"


def mean(column: str, digits: int) -> str:
    scale = 10 ** digits
    total = f"CAST(sum(CAST(round({column} * 100) AS BIGINT)) AS BIGINT)"
    return f"CAST(({total} * {2 * scale} + count(*) * 100) // (2 * count(*) * 100) AS DOUBLE) / {scale}"


def trend(digits: int) -> str:
    return (f"trend AS (SELECT scan_date, {mean('health_score', digits)} AS score, "
            "CAST(sum(total_issues) AS BIGINT) AS issues, CAST(sum(rows_at_risk) AS BIGINT) AS rows_at_risk "
            "FROM history GROUP BY scan_date)")


def on_history(query: str, *ctes: str) -> str:
    return with_views(query, *YEARS, HISTORY, LATEST, *ctes)


def rounded(units: str) -> str:
    return f"sign({units}) * CAST((abs({units}) + 5000) // 10000 AS DOUBLE) / 100"


def tenths(units: str) -> str:
    return (f"CAST(((abs({units}) + 50000) // 100000) // 10 AS VARCHAR) || '.' || "
            f"CAST(((abs({units}) + 50000) // 100000) % 10 AS VARCHAR)")


def units(a: str, b: str) -> str:
    return f"(CAST(round({a} * 1000000) AS BIGINT) - CAST(round({b} * 1000000) AS BIGINT))"


CHANGE = units("score", "previous_score")
TRUST_CHANGE = f"""SELECT scan_date, score, previous_score, issues, previous_issues, {rounded(CHANGE)} AS change,
 CASE WHEN {CHANGE} > 0 THEN 'Trust improved +' || {tenths(CHANGE)} || ' pts. Issues: ' || previous_issues || ' → ' || issues
  WHEN {CHANGE} < 0 THEN 'Trust dropped -' || {tenths(CHANGE)} || ' pts. Investigate recent ingestion.'
  ELSE 'Stable since last scan.' END AS message
 FROM (SELECT scan_date, score, lag(score) OVER w AS previous_score, issues, lag(issues) OVER w AS previous_issues,
  row_number() OVER (ORDER BY scan_date DESC) AS rn, count(*) OVER () AS n FROM trend WINDOW w AS (ORDER BY scan_date)) x
 WHERE rn = 1 AND n > 1"""
TRUST_DELTA = f"""SELECT min(scan_date) AS first_date, max(scan_date) AS last_date,
 arg_min(score, scan_date) AS first_score, arg_max(score, scan_date) AS last_score,
 arg_max(issues, scan_date) AS issues, arg_max(rows_at_risk, scan_date) AS rows_at_risk,
 {rounded(units('arg_max(score, scan_date)', 'arg_min(score, scan_date)'))} AS delta FROM trend"""

MONTHS = periods("month", *SCANNED)
ORDER_MONTHS = periods("month", "orders_dirty", later_today=False)

CONTRACT_ROWS = """contracts AS (SELECT * FROM (VALUES
 (1, 'orders_dirty', 'Order quantity must be positive', 'quantity <= 0', 'HIGH', TIMESTAMP '2024-05-01 09:00:00',
  (SELECT count(*) FROM orders_dirty WHERE quantity <= 0)),
 (2, 'customer_dirty', 'Every customer has an e-mail address', 'email IS NULL OR trim(email) = ''''', 'MEDIUM',
  TIMESTAMP '2024-05-02 09:00:00', (SELECT count(*) FROM customer_dirty WHERE email IS NULL OR trim(email, ' ') = '')),
 (3, 'part_dirty', 'Products sell above cost', 'cost_price >= unit_price', 'HIGH', TIMESTAMP '2024-05-03 09:00:00',
  (SELECT count(*) FROM part_dirty WHERE cost_price >= unit_price)),
 (4, 'orders_dirty', 'Orders arrive within thirty days', 'delivery_date > order_date + INTERVAL ''30'' DAY', 'LOW',
  TIMESTAMP '2024-05-04 09:00:00', (SELECT count(*) FROM orders_dirty WHERE delivery_date > order_date + INTERVAL '30' DAY)),
 (5, 'lineitem', 'Line numbers start at one', 'l_linenumber < 1', 'LOW', TIMESTAMP '2024-05-05 09:00:00',
  (SELECT count(*) FROM lineitem WHERE l_linenumber < 1)),
 (6, 'lineitem', 'Discounts stay below ten percent', 'l_discount >= 0.1', 'MEDIUM', TIMESTAMP '2024-05-06 09:00:00',
  (SELECT count(*) FROM lineitem WHERE l_discount >= CAST(0.1 AS DOUBLE))),
 (8, 'orders_dirty', 'Refers to a column that is gone', 'no_such_column > 1', 'LOW', TIMESTAMP '2024-05-08 09:00:00', NULL),
 (9, 'orders_dirty', 'Carries a comment', 'quantity <= 0 -- zero counts too', 'LOW', TIMESTAMP '2024-05-09 09:00:00',
  (SELECT count(*) FROM orders_dirty WHERE quantity <= 0)),
 (10, 'orders_dirty', 'Counts rows instead of testing one', 'count(1) > 0', 'LOW', TIMESTAMP '2024-05-10 09:00:00', NULL),
 (11, 'orders_dirty', 'Looks at other rows', 'row_number() OVER (ORDER BY order_id) > 1', 'LOW',
  TIMESTAMP '2024-05-11 09:00:00', NULL),
 (12, 'orders_dirty', 'Divides by zero', '10 / (quantity - quantity) > 1', 'LOW', TIMESTAMP '2024-05-12 09:00:00', NULL)
 ) v(contract_id, table_name, natural_language_rule, generated_sql_check, severity, created_at, violations))"""

HEALTH_BAND = ("CASE WHEN health_score >= 85 THEN 'green' WHEN health_score >= 70 THEN 'blue' "
               "WHEN health_score >= 50 THEN 'orange' ELSE 'red' END")
LONG_SCORES = "long_scores AS (" + " UNION ALL ".join(
    f"SELECT table_name, '{d}' AS dimension, CAST({d.lower()}_score AS DOUBLE) AS score FROM scored"
    for d in DIMENSIONS) + ")"

FIRST_FIVE = "ORDER BY table_name, rule_seq, ordinal, column_name LIMIT 5"
CONTEXT = f"""SELECT issues, critical, top_issues, scores,
 'Scan found ' || issues || ' issues (' || critical || ' critical). Top: ' || top_issues || chr(10) || 'Scores:'
  || chr(10) || scores AS context
 FROM (SELECT count(*) AS issues, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM graded WHERE n > 0) a,
 (SELECT string_agg(description, '; ' ORDER BY table_name, rule_seq, ordinal) AS top_issues FROM
  (SELECT * FROM graded WHERE n > 0 {FIRST_FIVE}) f) b,
 (SELECT string_agg(table_name || ' ' || health_score || ' ' || total_issues || ' ' || scan_date, chr(10)
   ORDER BY scan_date DESC, table_name) AS scores FROM
  (SELECT * FROM history ORDER BY recorded_at DESC, scan_date DESC, table_name LIMIT 10) h) c"""


def context() -> str:
    yearly = graded(selects_of(SCANNED, unit="year"), "yearly")
    return with_views(CONTEXT, SCAN, yearly, scores("yearly", "table_name, scan_date"), HISTORY)


STREAM_COUNTS = " UNION ALL ".join(
    f"SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, '{c}' AS column_name, '{r}' AS rule_name, "
    f"count(*) FILTER (WHERE {p}) AS affected_rows, count(*) AS total_rows FROM events_dirty t GROUP BY 1"
    for r, c, p, _ in row_rules("events_dirty") if r != "ORPHAN_REFERENCE")
EVENT_SCAN = graded(count_selects("events_dirty"))

REPORTS = {
    **{f"rule_{n.lower()}": rule(n) for n in (
        "NULL_CHECK", "BLANK_STRING", "DUPLICATE_KEY", "EMAIL_FORMAT", "NEGATIVE_VALUE", "FUTURE_DATE",
        "INVALID_CATEGORY", "WHITESPACE", "ORPHAN_REFERENCE", "DATE_ORDERING", "AMOUNT_MISMATCH",
        "COST_EXCEEDS_PRICE")},
    **{f"rule_{n.lower()}": rule(n, declared=True) for n in (
        "DUPLICATE_ROW", "PHONE_FORMAT", "DATE_RANGE", "NUMERIC_RANGE", "CASE_CONSISTENCY")},
    "rule_freshness": event_rule(EVENT_SELECTS[0]),
    "rule_outlier_iqr": event_rule(EVENT_SELECTS[1]),
    "scan_issues": on_scan(
        "SELECT table_name, column_name, rule_category, rule_name, severity, n AS affected_rows, total AS total_rows, "
        "pct AS affected_percentage, description AS issue_description, impact AS business_impact, "
        "action AS recommended_action, fix AS remediation_sql, risk_level, confidence FROM graded WHERE n > 0"),
    "scan_issues_active": active_scan(),
    "scan_issues_catalog": catalog_scan(),
    "scan_results": on_scores(f"SELECT {ID} AS scan_id, {SCAN_COLUMNS} FROM scored"),
    "history_row": on_scores(
        f"SELECT {ID} AS scan_id, DATE '2024-06-01' AS scan_date, 'warehouse' AS database_name, "
        f"'quality' AS schema_name, table_name, {HEALTH}, {SCORES_AS_DOUBLE}, issues_found AS total_issues, "
        "critical_issues, rows_at_risk FROM scored"),
    "dimension_scores": on_scores("SELECT * FROM long_scores", LONG_SCORES),
    "health_score": on_scores(f"SELECT table_name, {HEALTH}, issues_found AS issues FROM scored"),
    "score_band": on_scores(
        f"SELECT table_name, 'HEALTH' AS dimension, CAST(health_score AS DOUBLE) AS score, {HEALTH_BAND} AS band "
        "FROM scored UNION ALL SELECT table_name, dimension, score, CASE WHEN score >= 80 THEN 'green' "
        "WHEN score >= 60 THEN 'orange' ELSE 'red' END FROM long_scores", LONG_SCORES),
    "issue_list": on_scan(
        'SELECT severity AS "Severity", column_name AS "Column", rule_category AS "Category", rule_name AS "Rule", '
        'n AS "Rows", pct AS "%", description AS "Description" FROM graded '
        "WHERE n > 0 AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM')"),
    "issue_list_filtered": on_scan(
        'SELECT severity AS "Severity", column_name AS "Column", rule_category AS "Category", rule_name AS "Rule", '
        'n AS "Rows", pct AS "%", description AS "Description" FROM graded '
        "WHERE n > 0 AND severity IN ('CRITICAL', 'HIGH') AND rule_category IN ('VALIDITY', 'INTEGRITY')"),
    "issue_categories": on_scan("SELECT DISTINCT rule_category FROM graded WHERE n > 0"),
    "issues_by_severity": on_scan(
        "SELECT table_name, severity, count(*) AS issues, list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity) "
        "AS severity_rank FROM graded WHERE n > 0 GROUP BY table_name, severity"),
    "top_critical": on_scan(
        f"SELECT {REPORT} FROM graded WHERE n > 0 AND severity IN ('CRITICAL', 'HIGH') {FIRST_FIVE}"),
    "issue_explanations": on_scan(
        "SELECT table_name, column_name, rule_name, '- **What:** ' || description || chr(10) || '- **Risk:** ' || impact "
        "|| chr(10) || '- **Fix:** ' || action AS explanation FROM graded WHERE n > 0"),
    "guardian_context": context(),
    "fix_queue": on_scan(
        "SELECT table_name, column_name, rule_name, severity, n AS affected_rows, risk_level, confidence, "
        f"fix AS remediation_sql, risk_level = 'LOW' AS is_safe FROM graded WHERE n > 0 AND {FIXABLE}"),
    "fix_summary": on_scan(
        f"SELECT count(*) AS total_issues, count(*) FILTER (WHERE {FIXABLE}) AS fixable, "
        f"count(*) FILTER (WHERE risk_level = 'LOW' AND {FIXABLE}) AS low_risk FROM graded WHERE n > 0"),
    "fix_one_log": one_log(),
    "remediation_log": before_after(LOG),
    "audit_remediations": before_after(
        "SELECT remediation_id, table_name, column_name, issue_type, severity, affected_rows, approval_status, "
        f"executed_at, execution_result FROM ({LOG}) x ORDER BY created_at DESC, remediation_id LIMIT 50"),
    "before_after": before_after(
        "SELECT table_name, CAST(b.health_score AS DOUBLE) AS score_before, CAST(a.health_score AS DOUBLE) AS score_after, "
        "b.issues_found AS issues_before, a.issues_found AS issues_after FROM scored b JOIN scored_after a "
        "USING (table_name)"),
    "run_cycle": before_after(
        "SELECT table_name, CAST(b.health_score AS DOUBLE) AS score_before, CAST(a.health_score AS DOUBLE) AS score_after, "
        "b.issues_found AS issues_before, a.issues_found AS issues_after, b.issues_found + a.issues_found AS issue_rows, "
        f"CAST(2 AS BIGINT) AS history_rows, (SELECT count(*) FROM ({LOG}) x WHERE x.table_name = b.table_name) AS fixes "
        "FROM scored b JOIN scored_after a USING (table_name)"),
    "health_by_month": with_views(
        "SELECT table_name, scan_date, total_rows, issues_found, rows_at_risk, health_score, previous_score, "
        "CAST(CAST(round(health_score * 10) AS BIGINT) - CAST(round(previous_score * 10) AS BIGINT) AS DOUBLE) / 10 "
        f"AS change FROM (SELECT table_name, scan_date, total_rows, issues_found, rows_at_risk, {HEALTH}, "
        "CAST(lag(scored.health_score) OVER (PARTITION BY table_name ORDER BY scan_date) AS DOUBLE) AS previous_score "
        "FROM scored) x", *ORDER_MONTHS),
    "history_latest": on_history("SELECT * FROM latest"),
    "history_latest_per_table": on_history(
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY scan_date DESC, "
        "recorded_at DESC, scan_id DESC) AS rn FROM history) x WHERE rn = 1"),
    "history_trend": on_history("SELECT * FROM trend", trend(2)),
    "history_by_table": on_history("SELECT * FROM history"),
    "health_latest": on_history(f"SELECT {mean('health_score', 2)} AS health_score FROM latest"),
    "overview_kpis": on_history(
        f"SELECT {mean('health_score', 2)} AS health_score, count(*) AS tables, CAST(sum(total_issues) AS BIGINT) AS issues, "
        "CAST(sum(critical_issues) AS BIGINT) AS critical, CAST(sum(rows_at_risk) AS BIGINT) AS rows_at_risk FROM latest"),
    "overview_dimensions": on_history(" UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {mean(f'{d.lower()}_score', 2)} AS score FROM latest" for d in DIMENSIONS)),
    "issues_by_table": on_history("SELECT table_name, total_issues, critical_issues FROM latest"),
    "trust_delta": on_history(TRUST_DELTA, trend(6)),
    "trust_change": on_history(TRUST_CHANGE, trend(6)),
    "audit_scans": with_views(
        f"SELECT {PERIOD_ID} AS scan_id, CAST(scan_date AS TIMESTAMP) AS scan_timestamp, table_name, total_rows, "
        f"issues_found, critical_issues, {HEALTH}, 'DEEP' AS scan_type FROM scored "
        "ORDER BY scan_timestamp DESC, scan_id LIMIT 50", *MONTHS),
    "contracts_eval": with_views(
        "SELECT contract_id, table_name, natural_language_rule, severity, created_at, violations, "
        "CASE WHEN violations IS NULL THEN 'CANNOT EVALUATE' WHEN violations = 0 THEN 'PASSING' ELSE 'VIOLATIONS' END "
        "AS status FROM contracts", CONTRACT_ROWS),
    "contracts_active": with_views("SELECT * FROM contracts", CONTRACT_ROWS),
    "stream_rule_counts": with_views(STREAM_COUNTS),
    "stream_health": with_views(
        f"SELECT {ID} AS scan_id, DATE '2024-06-01' AS scan_date, table_name, {HEALTH}, {SCORES_AS_DOUBLE}, "
        "issues_found AS total_issues, critical_issues, rows_at_risk FROM scored", EVENT_SCAN, SCORED),
}
