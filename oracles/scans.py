"""Scan oracles: one plain SELECT per rule and column, written out independently of the engine."""

from __future__ import annotations

from oracles.views import AS_OF
from plumbline.rules import RULES  # names, grades and texts only

EMAIL = "'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$'"
PHONE = "'^\\+?[0-9][0-9 ()-]{6,18}[0-9]$'"

COLUMNS = {
    "customer_dirty": ["customer_id", "name", "email", "phone", "segment", "date_of_birth", "account_score"],
    "orders_dirty": ["order_id", "customer_id", "order_date", "delivery_date", "quantity", "unit_price",
                     "total_amount", "order_status"],
    "part_dirty": ["product_id", "product_name", "category", "unit_price", "cost_price"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events_dirty": ["event_id", "ts", "user_id", "event_type", "amount"],
}
TEXT = {
    "customer_dirty": ["name", "email", "phone", "segment"],
    "orders_dirty": ["order_status"],
    "part_dirty": ["product_name", "category"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events_dirty": ["event_type"],
}
SEGMENTS = "'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'"
STATUSES = "'F', 'O', 'P'"
CATEGORIES = "'ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'"
EVENT_TYPES = "'click', 'error', 'purchase', 'signup', 'view'"
PARENT_DATE = ("l_shipdate < (SELECT max(o.o_orderdate) FROM orders o WHERE o.o_orderkey = l_orderkey)")


def orphan(column: str, parent: str, key: str) -> str:
    return f"{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = t.{column})"


# (rule, column, predicate, extra text parameters)
SPECIAL = {
    "customer_dirty": [
        ("EMAIL_FORMAT", "email", f"trim(email, ' ') <> '' AND NOT regexp_matches(email, {EMAIL})", {}),
        ("NEGATIVE_VALUE", "account_score", "account_score < 0", {}),
        ("FUTURE_DATE", "date_of_birth", f"date_of_birth > {AS_OF}", {}),
        ("INVALID_CATEGORY", "segment", f"segment NOT IN ({SEGMENTS})", {"allowed": SEGMENTS}),
    ],
    "orders_dirty": [
        ("NEGATIVE_VALUE", "quantity", "quantity < 0", {}),
        ("NEGATIVE_VALUE", "unit_price", "unit_price < 0", {}),
        ("NEGATIVE_VALUE", "total_amount", "total_amount < 0", {}),
        ("FUTURE_DATE", "order_date", f"order_date > {AS_OF}", {}),
        ("INVALID_CATEGORY", "order_status", f"order_status NOT IN ({STATUSES})", {"allowed": STATUSES}),
        ("ORPHAN_REFERENCE", "customer_id", orphan("customer_id", "customer_dirty", "customer_id"),
         {"parent": "customers", "parent_table": "customer_dirty", "parent_key": "customer_id"}),
        ("DATE_ORDERING", "delivery_date", "delivery_date < order_date", {"start": "order_date"}),
        ("AMOUNT_MISMATCH", "total_amount", "abs(total_amount - quantity * unit_price) > 0.01",
         {"quantity": "quantity", "price": "unit_price"}),
    ],
    "part_dirty": [
        ("NEGATIVE_VALUE", "unit_price", "unit_price < 0", {}),
        ("NEGATIVE_VALUE", "cost_price", "cost_price < 0", {}),
        ("INVALID_CATEGORY", "category", f"category NOT IN ({CATEGORIES})", {"allowed": CATEGORIES}),
        ("COST_EXCEEDS_PRICE", "cost_price", "cost_price > unit_price", {"price": "unit_price"}),
    ],
    "lineitem": [
        ("NEGATIVE_VALUE", "l_quantity", "l_quantity < 0", {}),
        ("NEGATIVE_VALUE", "l_extendedprice", "l_extendedprice < 0", {}),
        ("ORPHAN_REFERENCE", "l_orderkey", orphan("l_orderkey", "orders", "o_orderkey"),
         {"parent": "orders", "parent_table": "orders", "parent_key": "o_orderkey"}),
        ("ORPHAN_REFERENCE", "l_partkey", orphan("l_partkey", "part", "p_partkey"),
         {"parent": "parts", "parent_table": "part", "parent_key": "p_partkey"}),
        ("ORPHAN_REFERENCE", "l_suppkey", orphan("l_suppkey", "supplier", "s_suppkey"),
         {"parent": "suppliers", "parent_table": "supplier", "parent_key": "s_suppkey"}),
        ("DATE_ORDERING", "l_shipdate", PARENT_DATE,
         {"instead": "SELECT * FROM lineitem WHERE l_shipdate < (SELECT max(o_orderdate) FROM orders "
                     "WHERE o_orderkey = l_orderkey)"}),
    ],
    "events_dirty": [
        ("NEGATIVE_VALUE", "amount", "amount < 0", {}),
        ("INVALID_CATEGORY", "event_type", f"event_type NOT IN ({EVENT_TYPES})", {"allowed": EVENT_TYPES}),
        ("ORPHAN_REFERENCE", "user_id", orphan("user_id", "customer", "c_custkey"),
         {"parent": "users", "parent_table": "customer", "parent_key": "c_custkey"}),
    ],
    "events": [],
}
DECLARED = {
    "customer_dirty": [
        ("PHONE_FORMAT", "phone", f"trim(phone, ' ') <> '' AND NOT regexp_matches(phone, {PHONE})", {}),
        ("DATE_RANGE", "date_of_birth", "date_of_birth < DATE '1900-01-01'", {}),
        ("NUMERIC_RANGE", "account_score", "account_score < 0", {}),
    ],
    "orders_dirty": [
        ("DATE_RANGE", "order_date", "order_date < DATE '1900-01-01'", {}),
        ("NUMERIC_RANGE", "quantity", "quantity < 1 OR quantity > 50", {}),
    ],
    "part_dirty": [],
    "lineitem": [],
}
KEYS = {
    "customer_dirty": ["customer_id"], "orders_dirty": ["order_id"], "part_dirty": ["product_id"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events_dirty": ["event_id"],
}
NOUNS = {
    "customer_dirty": "customers", "orders_dirty": "orders", "part_dirty": "products", "lineitem": "line items",
    "events_dirty": "events",
}
PERIOD_COLUMN = {"orders_dirty": "order_date", "lineitem": "l_shipdate"}
SCANNED = ("customer_dirty", "lineitem", "orders_dirty", "part_dirty")
BY_NAME = {r.name: r for r in RULES}


def row_rules(table: str) -> list[tuple]:
    rules = [("NULL_CHECK", c, f"{c} IS NULL", {}) for c in COLUMNS[table]]
    rules += [("BLANK_STRING", c, f"trim({c}, ' ') = ''", {}) for c in TEXT[table]]
    rules += [("WHITESPACE", c, f"{c} <> trim({c}, ' ')", {}) for c in TEXT[table]]
    return rules + SPECIAL[table]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, table: str, column: str, params: dict) -> str:
    values = {"c": column, "t": table, "noun": NOUNS.get(table, "rows"), "as_of": "2024-06-01", **params}
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template.replace("{pattern}", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\z")


def _select(table: str, rule: str, column: str, params: dict, n: str, groups: str, source: str, by: str) -> str:
    r = BY_NAME[rule]
    ordinal = COLUMNS.get(table, []).index(column) if column in COLUMNS.get(table, []) else 0
    texts = ", ".join(
        f"{quote(fill(t, table, column, params))} AS {name}"
        for t, name in ((r.description, "d"), (r.impact, "impact"), (r.action, "action"), (params.get("instead", r.remediation), "fix"))
    )
    key = f"{by} AS scan_date, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {key}'{table}' AS table_name, '{column}' AS column_name, '{rule}' AS rule_name, "
        f"{r.seq} AS rule_seq, {ordinal} AS ordinal, '{r.category}' AS rule_category, '{r.severity}' AS fixed, "
        f"'{r.risk}' AS risk_level, CAST({r.confidence} AS DOUBLE) AS confidence, {texts}, "
        f"CAST({n} AS BIGINT) AS n, CAST({groups} AS BIGINT) AS g, count(*) AS total FROM {source}{group}"
    )


def period(table: str, unit: str, later_today: bool) -> str:
    """The scan that a row belongs to; rows of no past period may belong to the scan of today."""
    if table not in PERIOD_COLUMN:
        return f"CASE WHEN t.{KEYS[table][0]} IS NULL THEN {AS_OF} ELSE {AS_OF} END"
    date = f"t.{PERIOD_COLUMN[table]}"
    start = f"CAST(date_trunc('{unit}', {date}) AS DATE)"
    return f"CASE WHEN {date} <= {AS_OF} THEN {start} ELSE {AS_OF} END" if later_today else start


def count_selects(table: str, names=None, unit: str | None = None, declared: bool = False,
                  later_today: bool = True) -> list[str]:
    """One SELECT per rule and column of a table, per period if a unit is given."""
    by = period(table, unit, later_today) if unit else ""
    wanted = row_rules(table) + (DECLARED[table] if declared else [])
    selects = [
        _select(table, rule, column, params, f"count(*) FILTER (WHERE {pred})", "0", f"{table} t", by)
        for rule, column, pred, params in wanted if names is None or rule in names
    ]
    if names is None or "DUPLICATE_KEY" in names:
        key = KEYS[table]
        parts = ", ".join(key + ([by] if by else []))
        present = " AND ".join(f"{c} IS NOT NULL" for c in key)
        inner = (f"(SELECT *, CASE WHEN {present} THEN count(*) OVER (PARTITION BY {parts}) END AS copies "
                 f"FROM {table} t) t")
        distinct = f"count(DISTINCT ({', '.join(key)})) FILTER (WHERE copies > 1)"
        selects.append(_select(table, "DUPLICATE_KEY", ", ".join(key), {"present": present},
                               "count(*) FILTER (WHERE copies > 1)", distinct, inner, by))
    if declared and (names is None or "DUPLICATE_ROW" in names):
        columns = ", ".join(COLUMNS[table])
        inner = f"(SELECT *, count(*) OVER (PARTITION BY {columns}) AS copies FROM {table}) t"
        row = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in COLUMNS[table])
        selects.append(_select(table, "DUPLICATE_ROW", "*", {}, "count(*) FILTER (WHERE copies > 1)",
                               f"count(DISTINCT ({row})) FILTER (WHERE copies > 1)", inner, by))
    if declared and table == "customer_dirty" and (names is None or "CASE_CONSISTENCY" in names):
        inner = ("(SELECT a.segment, row_number() OVER (PARTITION BY a.word ORDER BY a.n DESC, a.segment) > 1 "
                 "AS variant FROM (SELECT t.segment, lower(trim(t.segment, ' ')) AS word, count(*) AS n "
                 "FROM customer_dirty t GROUP BY 1, 2) a) v RIGHT JOIN customer_dirty t ON v.segment = t.segment")
        selects.append(_select(table, "CASE_CONSISTENCY", "segment", {}, "count(*) FILTER (WHERE variant)", "0",
                               inner, by))
    return selects


EVENT_SELECTS = [
    _select("events", "FRESHNESS_CHECK", "ts", {},
            f"CASE WHEN date_diff('day', CAST(max(ts) AS DATE), {AS_OF}) > 30 THEN count(*) ELSE 0 END", "0",
            "events", ""),
    _select("events", "OUTLIER_DETECTION", "value", {},
            "count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))", "0",
            "events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q", ""),
]


def graded(selects: list[str], name: str = "graded") -> str:
    """Counts with percentage (also as whole hundredths), severity and description."""
    return f"""{name}_raw AS ({' UNION ALL '.join(selects)}),
{name}_pct AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE (n * 20000 + total) // (2 * total) END AS h FROM {name}_raw),
{name} AS (SELECT *, CAST(h AS DOUBLE) / 100 AS pct,
 CASE WHEN fixed <> '' THEN fixed WHEN h > 2000 THEN 'CRITICAL' WHEN h > 1000 THEN 'HIGH'
      WHEN h > 500 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 replace(replace(replace(d, '{{n}}', format('{{:,}}', n)), '{{pct}}', CAST(CAST(h AS DOUBLE) / 100 AS VARCHAR)),
         '{{groups}}', CAST(g AS VARCHAR)) AS description FROM {name}_pct)"""


def scores(source: str = "graded", by: str = "table_name", name: str = "scored") -> str:
    """Scores by the published formula, on decimals."""
    weights = {"COMPLETENESS": "0.25", "UNIQUENESS": "0.20", "VALIDITY": "0.20", "CONSISTENCY": "0.15",
               "INTEGRITY": "0.15", "FRESHNESS": "0.05"}
    dims = []
    for dimension in weights:
        where = f"FILTER (WHERE n > 0 AND rule_category = '{dimension}')"
        penalty = ("2.0 * CAST(h AS DECIMAL(18,0)) / 100 + CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 "
                   "WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 3 ELSE 5 END + 3")
        total = f"CAST(round(coalesce(sum({penalty}) {where}, 0), 2) AS DECIMAL(18,2))"
        dims.append(f"CAST(greatest(20, round(100 - least({total}, 80), 1)) AS DECIMAL(5,1)) "
                    f"AS {dimension.lower()}_score")
    weighted = " + ".join(f"{d.lower()}_score * CAST({w} AS DECIMAL(3,2))" for d, w in weights.items())
    return f"""{name}_dims AS (SELECT {by}, CAST(max(total) AS BIGINT) AS total_rows,
 count(*) FILTER (WHERE n > 0) AS issues_found,
 count(*) FILTER (WHERE n > 0 AND severity = 'CRITICAL') AS critical_issues,
 count(*) FILTER (WHERE n > 0 AND severity = 'HIGH') AS high_issues,
 count(*) FILTER (WHERE n > 0 AND severity = 'MEDIUM') AS medium_issues,
 count(*) FILTER (WHERE n > 0 AND severity = 'LOW') AS low_issues,
 CAST(sum(n) AS BIGINT) AS rows_at_risk,
 {', '.join(dims)} FROM {source} GROUP BY {by}),
{name} AS (SELECT *, CAST(round({weighted}, 1) AS DECIMAL(5,1)) AS health_score FROM {name}_dims)"""


def selects_of(tables, **options) -> list[str]:
    return [s for t in tables for s in count_selects(t, **options)]
