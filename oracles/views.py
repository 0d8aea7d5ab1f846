"""The dirty views as SQL common table expressions."""

AS_OF = "DATE '2024-06-01'"

CUSTOMER = """customer_dirty AS (
WITH b AS (SELECT
 CASE WHEN c_custkey % 500 = 7 THEN NULL ELSE c_custkey END AS customer_id,
 CASE WHEN c_custkey % 53 = 0 THEN concat('  ', c_name, ' ') ELSE c_name END AS name,
 CASE WHEN c_custkey % 101 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN '' WHEN c_custkey % 89 = 0 THEN '   '
      WHEN c_custkey % 83 = 0 THEN 'not-an-email' WHEN c_custkey % 79 = 0 THEN 'missing@'
      ELSE concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') END AS email,
 CASE WHEN c_custkey % 73 = 0 THEN 'bad' ELSE concat('+91-7', lpad(CAST(c_custkey AS VARCHAR(20)), greatest(9, length(CAST(c_custkey AS VARCHAR(20))))::INTEGER, '0')) END AS phone,
 CASE WHEN c_custkey % 61 = 0 THEN 'UNKNOWN' WHEN c_custkey % 47 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 211 = 0 THEN DATE '2030-01-01' ELSE DATE '1990-01-01' END AS date_of_birth,
 c_acctbal AS account_score FROM customer)
SELECT * FROM b UNION ALL SELECT * FROM b WHERE customer_id % 250 = 3)"""

ORDERS = """orders_dirty AS (
WITH b AS (SELECT
 CASE WHEN o_orderkey % 1009 = 5 THEN NULL ELSE o_orderkey END AS order_id,
 CASE WHEN o_orderkey % 173 = 0 THEN NULL WHEN o_orderkey % 131 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS customer_id,
 CASE WHEN o_orderkey % 311 = 0 THEN o_orderdate + INTERVAL '40' YEAR ELSE o_orderdate END AS order_date,
 CASE WHEN o_orderkey % 149 = 0 THEN o_orderdate - INTERVAL '5' DAY
      WHEN o_orderkey % 311 = 0 THEN o_orderdate + INTERVAL '41' YEAR
      ELSE o_orderdate + INTERVAL '3' DAY END AS delivery_date,
 CASE WHEN o_orderkey % 199 = 0 THEN -3 ELSE 1 + o_orderkey % 10 END AS quantity,
 CAST(50 + o_orderkey % 9950 AS DECIMAL(10,2)) AS unit_price,
 CAST((CASE WHEN o_orderkey % 199 = 0 THEN -3 ELSE 1 + o_orderkey % 10 END) * (50 + o_orderkey % 9950)
      + (CASE WHEN o_orderkey % 157 = 0 THEN 1 ELSE 0 END) AS DECIMAL(12,2)) AS total_amount,
 CASE WHEN o_orderkey % 113 = 0 THEN NULL WHEN o_orderkey % 109 = 0 THEN 'X' ELSE o_orderstatus END AS order_status
 FROM orders)
SELECT * FROM b UNION ALL SELECT * FROM b WHERE order_id % 401 = 0)"""

PART = """part_dirty AS (
SELECT p_partkey AS product_id, p_name AS product_name,
 CASE WHEN p_partkey % 59 = 0 THEN 'OTHER' WHEN p_partkey % 43 = 0 THEN NULL ELSE p_type END AS category,
 CASE WHEN p_partkey % 67 = 0 THEN -p_retailprice ELSE p_retailprice END AS unit_price,
 p_retailprice * (CASE WHEN p_partkey % 71 = 0 THEN 1.25e0 ELSE 0.5e0 END) AS cost_price FROM part)"""

EVENTS = """events_dirty AS (
WITH b AS (SELECT event_id, ts,
 CASE WHEN event_id % 173 = 0 THEN NULL WHEN event_id % 131 = 0 THEN user_id + 1000000 ELSE user_id END AS user_id,
 CASE WHEN event_id % 113 = 0 THEN NULL WHEN event_id % 109 = 0 THEN '' WHEN event_id % 107 = 0 THEN ' click '
      WHEN event_id % 103 = 0 THEN 'UNKNOWN' ELSE event_type END AS event_type,
 CASE WHEN event_id % 199 = 0 THEN -value ELSE value END AS amount FROM events)
SELECT * FROM b UNION ALL SELECT * FROM b WHERE event_id % 401 = 0)"""

ALL = (CUSTOMER, ORDERS, PART, EVENTS)


def with_views(query: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((*ALL, *ctes)) + "\n" + query
