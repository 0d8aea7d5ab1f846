"""Random small tables: every executed rule, score and fix against plain Python."""

import datetime as dt
import re
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from plumbline.binding import Binding, ForeignKey
from plumbline.plans.cycle import before_after
from plumbline.plans.scan import Workspace, scan
from plumbline.rules import SEVERITY_PENALTY, WEIGHTS
from plumbline.sources.values import literal_rows

AS_OF = dt.date(2024, 6, 1)
SCHEMA = ("order_id bigint, customer_id bigint, email string, status string, order_date timestamp_ntz, "
          "delivery_date timestamp_ntz, quantity bigint, unit_price decimal(10,2), total_amount decimal(12,2)")
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
TEXTS = ("email", "status")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
ALLOWED = ("open", "done")

days = st.sampled_from([None, *(dt.datetime(2024, 5, 30) + dt.timedelta(days=d) for d in range(5))])
money = st.sampled_from([None, Decimal("-2.00"), Decimal("0.00"), Decimal("1.50"), Decimal("3.00"), Decimal("3.01")])
order = st.tuples(
    st.one_of(st.none(), st.integers(1, 12)), st.one_of(st.none(), st.integers(1, 6)),
    st.sampled_from([None, "", "  ", "a@b.co", " a@b.co", "a@b", "x"]),
    st.sampled_from([None, "", "open", "done ", "lost"]), days, days,
    st.one_of(st.none(), st.integers(-2, 3)), money, money,
)


def violations(rows, parents):
    """(rule, column) -> number of affected rows."""
    found = Counter()
    for row in rows:
        r = dict(zip(NAMES, row))
        for c, v in r.items():
            found["NULL_CHECK", c] += v is None
        for c in TEXTS:
            if r[c] is not None:
                found["BLANK_STRING", c] += r[c].strip(" ") == ""
                found["WHITESPACE", c] += r[c] != r[c].strip(" ")
        if r["email"] is not None and r["email"].strip(" "):
            found["EMAIL_FORMAT", "email"] += not EMAIL.fullmatch(r["email"])
        if r["status"] is not None:
            found["INVALID_CATEGORY", "status"] += r["status"] not in ALLOWED
        for c in ("quantity", "unit_price", "total_amount"):
            found["NEGATIVE_VALUE", c] += r[c] is not None and r[c] < 0
        if r["order_date"] is not None:
            found["FUTURE_DATE", "order_date"] += r["order_date"] > dt.datetime(2024, 6, 1)
        if r["customer_id"] is not None:
            found["ORPHAN_REFERENCE", "customer_id"] += r["customer_id"] not in parents
        if r["order_date"] and r["delivery_date"]:
            found["DATE_ORDERING", "delivery_date"] += r["delivery_date"] < r["order_date"]
        if None not in (r["quantity"], r["unit_price"], r["total_amount"]):
            off = abs(r["total_amount"] - r["quantity"] * r["unit_price"])
            found["AMOUNT_MISMATCH", "total_amount"] += off > Decimal("0.01")
    copies = Counter(row[0] for row in rows if row[0] is not None)
    found["DUPLICATE_KEY", "order_id"] = sum(n for n in copies.values() if n > 1)
    return {k: n for k, n in found.items() if n}


def health(issues):
    """The score formula on (category, severity, percentage) triples, in exact decimals."""
    total = Decimal(0)
    for dimension, weight in WEIGHTS.items():
        own = [(s, p) for c, s, p in issues if c == dimension]
        penalty = sum((2 * Decimal(str(p)) + SEVERITY_PENALTY[s] + 3 for s, p in own), Decimal(0))
        total += max(Decimal(20), 100 - min(penalty, Decimal(80))).quantize(Decimal("0.1"), "ROUND_HALF_UP") * Decimal(weight)
    return float(total.quantize(Decimal("0.1"), "ROUND_HALF_UP"))


def fixed(row):
    """The low-risk fixes in report order."""
    r = dict(zip(NAMES, row))
    for c in TEXTS:
        if r[c] is not None and r[c].strip(" ") == "":
            r[c] = None
    if r["status"] is not None and r["status"] not in ALLOWED:
        r["status"] = None
    for c in TEXTS:
        r[c] = r[c].strip(" ") if r[c] is not None else None
    if None not in (r["quantity"], r["unit_price"], r["total_amount"]):
        right = r["quantity"] * r["unit_price"]
        if abs(r["total_amount"] - right) > Decimal("0.01"):
            r["total_amount"] = right
    return tuple(r.values())


@pytest.mark.parametrize("part", range(2))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(order, min_size=0, max_size=60), parents=st.sets(st.integers(1, 6), max_size=5))
def test_scan_and_fix(spark, part, rows, parents):
    binding = Binding(
        noun="orders", foreign_keys=(ForeignKey("customer_id", "parents", "customer_id", "customers"),),
        allowed={"status": ALLOWED}, date_pairs=(("order_date", "delivery_date"),),
        amounts=(("total_amount", "quantity", "unit_price"),))
    ws = Workspace(spark, {
        "t": literal_rows(spark, SCHEMA, rows),
        "parents": literal_rows(spark, "customer_id bigint", [(p,) for p in parents]),
    }, {"t": binding}, AS_OF)
    issues = scan(ws, ["t"]).issues.collect()
    assert {(r.rule_name, r.column_name): r.affected_rows for r in issues} == violations(rows, parents)
    compared = before_after(ws, ["t"]).first()
    assert compared.score_before == health([(r.rule_category, r.severity, r.affected_percentage) for r in issues])
    after = [fixed(r) for r in rows]
    assert compared.issues_after == len(violations(after, parents))
