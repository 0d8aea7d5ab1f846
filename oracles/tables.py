"""Oracles of tables, profiles and row-level operators."""

from __future__ import annotations

from oracles.scans import COLUMNS, EMAIL, KEYS, SCANNED, SEGMENTS, TEXT, row_rules
from oracles.views import AS_OF, with_views

BASE = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
        "nation", "orders", "pages", "part", "region", "supplier")
WIDTHS = {"benchmark": 2, "conversations": 4, "customer": 5, "documents": 5, "embeddings": 3, "events": 6,
          "labels": 3, "lineitem": 11, "nation": 3, "orders": 6, "pages": 3, "part": 6, "region": 2, "supplier": 4}
ORDER_COLUMNS = ("order_id, customer_id, order_date, delivery_date, CAST(quantity AS BIGINT) AS quantity, "
                 "CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_amount AS DOUBLE) AS total_amount, order_status")

TYPES = {
    "customer_dirty": ["bigint", "string", "string", "string", "string", "date", "double"],
    "orders_dirty": ["bigint", "bigint", "timestamp_ntz", "timestamp_ntz", "bigint", "decimal(10,2)",
                     "decimal(12,2)", "string"],
    "part_dirty": ["bigint", "string", "string", "double", "double"],
    "lineitem": ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string",
                 "timestamp_ntz"],
}
NOT_NULLABLE: set = set()
NUMERIC = {
    "customer_dirty": ["customer_id", "account_score"],
    "orders_dirty": ["order_id", "customer_id", "quantity", "unit_price", "total_amount"],
    "part_dirty": ["product_id", "unit_price", "cost_price"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"],
}


def hundredths(part: str, total: str) -> str:
    return (f"CASE WHEN {total} = 0 THEN 0.0::DOUBLE ELSE "
            f"CAST((({part}) * 20000 + {total}) // (2 * {total}) AS DOUBLE) / 100 END")


def profile_columns() -> str:
    parts = []
    for t in SCANNED:
        for i, (c, kind) in enumerate(zip(COLUMNS[t], TYPES[t]), start=1):
            nullable = "NO" if (t, c) in NOT_NULLABLE else "YES"
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal_position, '{kind}' AS data_type, "
                f"'{nullable}' AS is_nullable, count(*) AS total_rows, count(*) - count({c}) AS null_count, "
                f"{hundredths(f'count(*) - count({c})', 'count(*)')} AS null_pct, "
                f"count(DISTINCT {c}) AS distinct_count, "
                f"{hundredths(f'count(DISTINCT {c})', 'count(*)')} AS uniqueness_pct FROM {t}")
    return with_views(" UNION ALL ".join(parts))


def exact_median(table: str, column: str) -> str:
    """The median of integers and decimals with four places, as text."""
    if TYPES[table][COLUMNS[table].index(column)] == "double":
        return "NULL::VARCHAR"
    values, n = f"list_sort(list({column}) FILTER ({column} IS NOT NULL))", f"count({column})"
    middle = [f"CAST({values}[{place}] AS DECIMAL(38, 4))" for place in (f"({n} + 1) // 2", f"{n} // 2 + 1")]
    return f"CAST(CAST(({middle[0]} + {middle[1]}) * 0.5 AS DECIMAL(38, 4)) AS VARCHAR)"


def profile_numeric() -> str:
    return with_views(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, "
        f"CAST(max({c}) AS DOUBLE) AS max_value, round(avg(CAST({c} AS DOUBLE)), 2) AS mean_value, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median_value, {exact_median(t, c)} AS median_exact, "
        f"round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS stddev_value FROM {t}"
        for t in SCANNED for c in NUMERIC[t]))


def profile_text() -> str:
    return with_views(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, min(length({c})) AS min_length, "
        f"max(length({c})) AS max_length, "
        f"CAST((CAST(sum(length({c})) AS BIGINT) * 20 + count({c})) // (2 * count({c})) AS DOUBLE) / 10 AS avg_length "
        f"FROM {t}"
        for t in SCANNED for c in TEXT[t]))


def profile_top_values() -> str:
    return with_views(" UNION ALL ".join(
        f"(SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, count(*) AS value_count FROM {t} "
        f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 5)"
        for t in SCANNED for c in TEXT[t]))


def duplicates() -> str:
    parts = []
    for t in SCANNED:
        key = ", ".join(KEYS[t])
        present = " AND ".join(f"{c} IS NOT NULL" for c in KEYS[t])
        shown = " || ', ' || ".join(f"CAST({c} AS VARCHAR)" for c in KEYS[t])
        parts.append(f"SELECT '{t}' AS table_name, {shown} AS key_value, count(*) AS n_rows FROM {t} "
                     f"WHERE {present} GROUP BY {key} HAVING count(*) > 1")
    return with_views(" UNION ALL ".join(parts))


def at_risk() -> str:
    """Every row flagged by any rule, by windows and subqueries over the whole table."""
    parts = []
    for t in SCANNED:
        tests = " OR ".join(f"coalesce({pred}, FALSE)" for _, _, pred, _ in row_rules(t))
        key = ", ".join(KEYS[t])
        present = " AND ".join(f"{c} IS NOT NULL" for c in KEYS[t])
        parts.append(
            f"SELECT '{t}' AS table_name, count(*) FILTER (WHERE hit OR (copies > 1 AND present)) AS rows_at_risk, "
            f"count(*) AS total_rows FROM (SELECT {tests} AS hit, count(*) OVER (PARTITION BY {key}) AS copies, "
            f"{present} AS present FROM {t} t) x")
    return with_views(" UNION ALL ".join(parts))


BAD_EMAIL = f"(trim(email, ' ') <> '' AND NOT regexp_matches(email, {EMAIL}))"


# Accepted values of columns that have a list of them.
LISTED = {("customer_dirty", "segment"): f"({SEGMENTS})", ("orders_dirty", "order_status"): "('F', 'O', 'P')",
          ("part_dirty", "category"): "('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD')"}


def images() -> str:
    """The rows that each low-risk fix changes: blanks, then unknown categories, then spaces around, then amounts."""
    parts = []

    def changed(table: str, rule: str, column: str, test: str, empties: str) -> None:
        parts.append(f"SELECT '{table}' AS table_name, '{rule}' AS rule_name, '{column}' AS column_name, count(*) AS changed_rows, "
                     f"count(*) FILTER (WHERE {empties}) AS emptied_rows FROM {table} WHERE {test} HAVING count(*) > 0")

    for t in SCANNED:
        for c in TEXT[t]:
            filled, known = f"trim({c}, ' ') <> ''", "TRUE"
            changed(t, "BLANK_STRING", c, f"trim({c}, ' ') = ''", "TRUE")
            if (t, c) in LISTED:
                known = f"{c} IN {LISTED[t, c]}"
                changed(t, "INVALID_CATEGORY", c, f"{filled} AND NOT {known}", "TRUE")
            changed(t, "WHITESPACE", c, f"{filled} AND {known} AND {c} <> trim({c}, ' ')", "FALSE")
    off = "abs(total_amount - quantity * unit_price) > 0.01"
    changed("orders_dirty", "AMOUNT_MISMATCH", "total_amount", off, "FALSE")
    return " UNION ALL ".join(parts)


def null_if(test: str, column: str) -> str:
    return f"CASE WHEN {test} THEN NULL ELSE {column} END AS {column}"


def blank_to_null(c: str) -> str:
    return null_if(f"trim({c}, ' ') = ''", c)


def repeated(table: str, key: str) -> str:
    """The key values of a table that stand more than once."""
    present = " AND ".join(f"{c} IS NOT NULL" for c in key.split(", "))
    return f"FROM (SELECT {key} FROM {table} WHERE {present} GROUP BY {key} HAVING count(*) > 1)"


def counted(sources) -> str:
    """The rows of each (table, column, rule, source)."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{rule}' AS rule_name, count(*) AS n_rows {source}"
        for table, column, rule, source in sources)


TABLES = {
    "table_row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, {WIDTHS[t]} AS column_count FROM {t}" for t in BASE),
    "sample_rows": with_views(
        f"SELECT {ORDER_COLUMNS} FROM orders_dirty ORDER BY orders_dirty.order_id NULLS LAST, "
        "orders_dirty.customer_id NULLS LAST, orders_dirty.order_date LIMIT 10"),
    "inject_defects_customer": with_views("SELECT * FROM customer_dirty"),
    "inject_defects_orders": with_views(f"SELECT {ORDER_COLUMNS} FROM orders_dirty"),
    "inject_defects_part": with_views("SELECT * FROM part_dirty"),
    "profile_columns": profile_columns(),
    "profile_numeric": profile_numeric(),
    "profile_text": profile_text(),
    "profile_top_values": profile_top_values(),
    "violations_duplicates": duplicates(),
    "violations_orphans": with_views(" UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, concat_ws(', ', {key}) AS key_value, "
        f"CAST({column} AS VARCHAR) AS reference FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN "
        f"(SELECT {parent_key} FROM {parent} WHERE {parent_key} IS NOT NULL)"
        for table, key, column, parent, parent_key in (
            ("orders_dirty", "order_id", "customer_id", "customer_dirty", "customer_id"),
            ("lineitem", "l_orderkey, l_linenumber", "l_orderkey", "orders", "o_orderkey"),
            ("lineitem", "l_orderkey, l_linenumber", "l_partkey", "part", "p_partkey"),
            ("lineitem", "l_orderkey, l_linenumber", "l_suppkey", "supplier", "s_suppkey")))),
    "remediation_selects": with_views(counted((
        ("customer_dirty", "customer_id", "DUPLICATE_KEY", repeated("customer_dirty", "customer_id")),
        ("lineitem", "l_orderkey, l_linenumber", "DUPLICATE_KEY", repeated("lineitem", "l_orderkey, l_linenumber")),
        ("orders_dirty", "order_id", "DUPLICATE_KEY", repeated("orders_dirty", "order_id")),
        ("part_dirty", "product_id", "DUPLICATE_KEY", repeated("part_dirty", "product_id")),
        ("orders_dirty", "customer_id", "ORPHAN_REFERENCE", "FROM orders_dirty o LEFT JOIN (SELECT DISTINCT customer_id FROM "
         "customer_dirty) c USING (customer_id) WHERE o.customer_id IS NOT NULL AND c.customer_id IS NULL"),
        ("lineitem", "l_orderkey", "ORPHAN_REFERENCE", "FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey"),
        ("lineitem", "l_partkey", "ORPHAN_REFERENCE", "FROM lineitem ANTI JOIN part ON l_partkey = p_partkey"),
        ("lineitem", "l_suppkey", "ORPHAN_REFERENCE", "FROM lineitem ANTI JOIN supplier ON l_suppkey = s_suppkey"),
        ("lineitem", "l_shipdate", "DATE_ORDERING", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
         "WHERE l_shipdate < o_orderdate"),
        ("part_dirty", "cost_price", "COST_EXCEEDS_PRICE", "FROM part_dirty WHERE cost_price > unit_price")))),
    "remediation_where": with_views(counted((
        *((t, c, "BLANK_STRING", f"FROM {t} WHERE {c} IS NOT NULL AND length(trim({c}, ' ')) = 0") for t in TEXT for c in TEXT[t]
          if t != "events_dirty"),
        *((t, c, "WHITESPACE", f"FROM {t} WHERE {c} LIKE ' %' OR {c} LIKE '% '") for t in TEXT for c in TEXT[t] if t != "events_dirty"),
        ("customer_dirty", "email", "EMAIL_FORMAT", f"FROM customer_dirty WHERE {BAD_EMAIL}"),
        *((t, c, "NEGATIVE_VALUE", f"FROM {t} WHERE {c} < 0") for t, c in (
            ("customer_dirty", "account_score"), ("orders_dirty", "quantity"), ("orders_dirty", "unit_price"),
            ("orders_dirty", "total_amount"), ("part_dirty", "unit_price"), ("part_dirty", "cost_price"),
            ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"))),
        ("customer_dirty", "date_of_birth", "FUTURE_DATE", f"FROM customer_dirty WHERE date_of_birth > {AS_OF}"),
        ("orders_dirty", "order_date", "FUTURE_DATE", f"FROM orders_dirty WHERE order_date > {AS_OF}"),
        ("customer_dirty", "segment", "INVALID_CATEGORY", f"FROM customer_dirty WHERE segment NOT IN ({SEGMENTS})"),
        ("orders_dirty", "order_status", "INVALID_CATEGORY", "FROM orders_dirty WHERE order_status NOT IN ('F', 'O', 'P')"),
        ("part_dirty", "category", "INVALID_CATEGORY", "FROM part_dirty WHERE category NOT IN "
         "('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD')"),
        ("orders_dirty", "delivery_date", "DATE_ORDERING", "FROM orders_dirty WHERE delivery_date < order_date"),
        ("orders_dirty", "total_amount", "AMOUNT_MISMATCH",
         "FROM orders_dirty WHERE abs(total_amount - quantity * unit_price) > 0.01")))),
    "violations_cost": with_views(
        "SELECT product_id, product_name, cost_price, unit_price FROM part_dirty WHERE cost_price > unit_price"),
    "rows_at_risk_distinct": at_risk(),
    "fix_blank_string": with_views(
        "SELECT customer_id, " + ", ".join(blank_to_null(c) for c in TEXT["customer_dirty"])
        + " FROM customer_dirty"),
    "fix_email": with_views(f"SELECT customer_id, {null_if(BAD_EMAIL, 'email')} FROM customer_dirty"),
    "fix_negative": with_views(
        "SELECT order_id, CASE WHEN quantity < 0 THEN NULL ELSE CAST(quantity AS BIGINT) END AS quantity, "
        "CASE WHEN unit_price < 0 THEN NULL ELSE CAST(unit_price AS DOUBLE) END AS unit_price, "
        "CASE WHEN total_amount < 0 THEN NULL ELSE CAST(total_amount AS DOUBLE) END AS total_amount "
        "FROM orders_dirty"),
    "fix_future_date": with_views(
        f"SELECT order_id, {null_if(f'order_date > {AS_OF}', 'order_date')} FROM orders_dirty"),
    "fix_invalid_category": with_views(
        f"SELECT customer_id, {null_if(f'segment NOT IN ({SEGMENTS})', 'segment')} FROM customer_dirty"),
    "fix_whitespace": with_views(
        "SELECT customer_id, " + ", ".join(f"trim({c}, ' ') AS {c}" for c in TEXT["customer_dirty"])
        + " FROM customer_dirty"),
    "fix_date_swap": with_views(
        "SELECT order_id, least(order_date, delivery_date) AS order_date, "
        "greatest(order_date, delivery_date) AS delivery_date FROM orders_dirty"),
    "fix_amount": with_views(
        "SELECT order_id, CAST(CASE WHEN abs(total_amount - quantity * unit_price) > 0.01 "
        "THEN quantity * unit_price ELSE total_amount END AS DOUBLE) AS total_amount FROM orders_dirty"),
    "fix_one": with_views(
        f"SELECT customer_id, {null_if(f'date_of_birth > {AS_OF}', 'date_of_birth')} FROM customer_dirty"),
    "fix_dedup": with_views(
        f"SELECT {ORDER_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY order_date, "
        "customer_id NULLS FIRST, delivery_date) AS rn FROM orders_dirty) x WHERE rn = 1 OR order_id IS NULL"),
    "fix_images": with_views(images()),
    "fix_undo": with_views(
        "SELECT customer_id, CASE WHEN trim(name, ' ') = '' THEN NULL WHEN count(*) OVER (PARTITION BY customer_id) = 1 THEN name "
        "ELSE trim(name, ' ') END AS name, CASE WHEN trim(email, ' ') <> '' THEN trim(email, ' ') END AS email, "
        f"CASE WHEN trim(segment, ' ') <> '' AND segment IN ({SEGMENTS}) THEN trim(segment, ' ') END AS segment FROM customer_dirty"),
    "fix_rollback": with_views(" UNION ALL ".join(
        f"SELECT '{version}' AS version, customer_id, {name} AS name, {email} AS email, {segment} AS segment, "
        f"{name} <> trim({name}, ' ') AS is_padded FROM customer_dirty"
        for version, name, email, segment in (
            ("original", "name", "email", "segment"),
            ("fixed", "trim(name, ' ')", "CASE WHEN trim(email, ' ') <> '' THEN trim(email, ' ') END",
             f"CASE WHEN segment IN ({SEGMENTS}) THEN segment END"),
            ("restored", "name", "email", "segment")))),
    "stream_dedup": with_views(
        "SELECT event_id, ts, user_id, event_type, amount FROM (SELECT *, row_number() OVER "
        "(PARTITION BY event_id) AS rn FROM events_dirty) x WHERE rn = 1"),
    "stream_orphans": with_views(
        "SELECT event_id, user_id, ts FROM events_dirty WHERE user_id IS NOT NULL "
        "AND user_id NOT IN (SELECT c_custkey FROM customer)"),
}
