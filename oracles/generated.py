"""Oracles of the generated tables: list lookups instead of joins."""

from __future__ import annotations

import zlib

from plumbline.sources import generators as g  # the fixed lists only

AS_OF = "DATE '2024-06-01'"
NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def pick(values, index: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[{index}]"


def spread(name: str, size) -> str:
    salt = zlib.crc32(name.encode())
    return f"((((id % 2147483648) * 1103515245 + CAST({salt} AS BIGINT) * 12345) // 64) % {size})"


def days(amount: str) -> str:
    return f"to_days(CAST({amount} AS INTEGER))"


def column(values, i: int):
    return tuple(v[i] for v in values)


CUSTOMERS = f"""WITH s AS (SELECT CAST(c_custkey + 1 AS BIGINT) AS id FROM customer),
n AS (SELECT id, {pick(g.FIRST_NAMES, '(id - 1) % 20 + 1')} AS fn,
 {pick(g.LAST_NAMES, '((id - 1) // 20) % 15 + 1')} AS ln FROM s)
SELECT id AS customer_id, fn AS first_name, ln AS last_name,
 lower(fn) || '.' || lower(ln) || id || '@' || {pick(g.DOMAINS, '(id - 1) % 5 + 1')} AS email,
 '+91-7' || lpad(CAST({spread("line", 1000000000)} AS VARCHAR), 9, '0') AS phone,
 id || ' ' || {pick(g.STREETS, '(id - 1) % 5 + 1')} AS address,
 {pick(column(g.CITIES, 0), '(id - 1) % 8 + 1')} AS city, {pick(column(g.CITIES, 1), '(id - 1) % 8 + 1')} AS state,
 'India' AS country, '400' || lpad(CAST(id % 300 + 1 AS VARCHAR), 3, '0') AS postal_code,
 CAST({AS_OF} - {days(spread("date_of_birth", 25000) + ' + 6000')} AS DATE) AS date_of_birth,
 {NOW} - {days(spread("registration_date", 2000))} AS registration_date,
 {pick(g.SEGMENTS, '(id - 1) % 4 + 1')} AS customer_segment,
 300 + {spread("credit_score", 551)} AS credit_score, CAST(100000 + {spread("annual_income", 4900000)} AS DOUBLE) AS annual_income,
 TRUE AS is_active, {NOW} - {days(spread("last_login", 30))} AS last_login FROM n"""

PRODUCTS = f"""WITH s AS (SELECT CAST(p_partkey + 1 AS BIGINT) AS id FROM part)
SELECT id AS product_id, 'Product_' || id AS product_name,
 {pick(column(g.CATEGORIES, 0), '(id - 1) % 15 + 1')} AS category,
 {pick(column(g.CATEGORIES, 1), '(id - 1) % 15 + 1')} AS sub_category,
 {pick(g.BRANDS, '(id - 1) % 5 + 1')} AS brand,
 CAST(50 + {spread("unit_price", 9950)} AS DOUBLE) AS unit_price, CAST(25 + {spread("cost_price", 4975)} AS DOUBLE) AS cost_price,
 10 + {spread("stock_quantity", 491)} AS stock_quantity, 5 + {spread("reorder_level", 46)} AS reorder_level,
 CAST(10 + {spread("weight_kg", 2990)} AS DOUBLE) / 100 AS weight_kg, TRUE AS is_active,
 CAST({AS_OF} - {days(spread("created_date", 900) + ' + 30')} AS DATE) AS created_date, {NOW} AS last_updated FROM s"""

CUSTOMER_COUNT = "(SELECT count(*) FROM customer)"
PART_COUNT = "(SELECT count(*) FROM part)"
ORDERS = f"""WITH s AS (SELECT CAST(o_orderkey + 1 AS BIGINT) AS id FROM orders),
n AS (SELECT id, 1 + {spread("customer_id", CUSTOMER_COUNT)} AS customer_id, 1 + {spread("product_id", PART_COUNT)} AS product_id,
 {spread("age", 730)} AS age, {spread("transit", 7)} AS transit, 1 + {spread("quantity", 10)} AS quantity,
 50 + {spread("unit_price", 9950)} AS price FROM s)
SELECT id AS order_id, customer_id, product_id, {NOW} - {days('age')} AS order_date,
 {NOW} - {days('age - 3 - transit')} AS delivery_date, quantity, CAST(price AS DOUBLE) AS unit_price,
 CAST(quantity * price AS DOUBLE) AS total_amount, CAST({spread("discount_pct", 2500)} AS DOUBLE) / 100 AS discount_pct,
 {pick(g.PAYMENT_METHODS, '(id - 1) % 5 + 1')} AS payment_method,
 {pick(g.STATUSES, '(id - 1) % 5 + 1')} AS order_status, customer_id || ' Main St' AS shipping_address,
 {pick(column(g.ORDER_CITIES, 0), 'id % 6 + 1')} AS city, {pick(column(g.ORDER_CITIES, 1), 'id % 6 + 1')} AS state,
 'India' AS country FROM n"""

LISTS = (
    ("first_name", g.FIRST_NAMES, "c_custkey % 20 + 1"), ("last_name", g.LAST_NAMES, "(c_custkey // 20) % 15 + 1"),
    ("domain", g.DOMAINS, "c_custkey % 5 + 1"), ("city", column(g.CITIES, 0), "c_custkey % 8 + 1"),
    ("state", column(g.CITIES, 1), "c_custkey % 8 + 1"), ("street", g.STREETS, "c_custkey % 5 + 1"),
    ("segment", g.SEGMENTS, "c_custkey % 4 + 1"),
)


def entries(name, values, index) -> str:
    rows = ", ".join(f"({i}, '{v}')" for i, v in enumerate(values, start=1))
    return (f"SELECT '{name}' AS dimension, CAST(v.idx AS BIGINT) AS idx, v.value, "
            f"(SELECT count(*) FROM customer WHERE {index} = v.idx) AS members FROM (VALUES {rows}) v(idx, value)")


GENERATED = {
    "gen_customers": CUSTOMERS,
    "gen_products": PRODUCTS,
    "gen_orders": ORDERS,
    "gen_dim_values": " UNION ALL ".join(entries(*entry) for entry in LISTS),
}
