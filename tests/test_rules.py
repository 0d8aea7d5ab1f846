"""Binding, predicates and edge cases of the rules."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.binding import Binding, ForeignKey, bind
from plumbline.operators import issues as issue_ops
from plumbline.operators.fixes import apply_fixes, can_fix, choose, deduplicate, safe_rules
from plumbline.plans.scan import Workspace, scan
from plumbline.sources import seed
from plumbline.sources.values import literal_rows
from tests.conftest import rows

AS_OF = dt.date(2024, 6, 1)


def workspace(spark, bindings=None, **tables):
    return Workspace(spark, tables, bindings or {}, AS_OF)


def affected(ws, name, rule_set="executed"):
    return {
        (r.rule_name, r.column_name): r.affected_rows for r in scan(ws, [name], rule_set).issues.collect()
    }


def test_binding_follows_names_and_types(spark):
    schema = literal_rows(
        spark,
        "Account_ID bigint, other_id bigint, work_EMAIL string, net_price double, price_note string, "
        "order_day date, shipped date, created_at timestamp_ntz, order_no int, flag boolean", []).schema
    bound = bind("t", schema, Binding(), AS_OF)
    by_rule = {}
    for b in bound:
        by_rule.setdefault(b.rule.name, []).append(b.column)
    assert by_rule["NULL_CHECK"] == schema.names
    assert by_rule["DUPLICATE_KEY"] == ["Account_ID"]
    assert by_rule["EMAIL_FORMAT"] == ["work_EMAIL"]
    assert by_rule["NEGATIVE_VALUE"] == ["net_price"]
    assert by_rule["FUTURE_DATE"] == ["order_day", "created_at"]
    assert by_rule["BLANK_STRING"] == by_rule["WHITESPACE"] == ["work_EMAIL", "price_note"]
    assert [b.rule.seq for b in bound] == sorted(b.rule.seq for b in bound)


@pytest.mark.parametrize("value, blank, bad_email, padded", [
    ("a@b.com", 0, 0, 0), ("a@b.co", 0, 0, 0), ("a@b.c", 0, 1, 0), ("a@b.com\n", 0, 1, 0), (" a@b.com", 0, 1, 1),
    ("", 1, 0, 0), ("   ", 1, 0, 1), (" ", 0, 1, 0), (None, 0, 0, 0), ("missing@", 0, 1, 0),
])
def test_text_rules(spark, value, blank, bad_email, padded):
    ws = workspace(spark, t=literal_rows(spark, "email string", [(value,)]))
    got = affected(ws, "t")
    assert got.get(("BLANK_STRING", "email"), 0) == blank
    assert got.get(("EMAIL_FORMAT", "email"), 0) == bad_email
    assert got.get(("WHITESPACE", "email"), 0) == padded


def test_boundaries(spark):
    day = dt.datetime(2024, 1, 2)
    schema = ("order_date timestamp_ntz, delivery_date timestamp_ntz, quantity bigint, unit_price decimal(10,2), "
              "total_amount decimal(12,2), cost_price decimal(10,2)")
    ws = workspace(
        spark,
        {"t": Binding(date_pairs=(("order_date", "delivery_date"),),
                      amounts=(("total_amount", "quantity", "unit_price"),), prices=(("cost_price", "unit_price"),))},
        t=literal_rows(spark, schema, [
            (day, day, 2, Decimal("5.00"), Decimal("10.01"), Decimal("5.00")),  # all at the limit: fine
            (dt.datetime(2024, 6, 1), None, 0, Decimal("5.00"), Decimal("0.02"), Decimal("5.01")),  # amount and cost
            (dt.datetime(2024, 6, 1, 0, 0, 1), day, None, None, None, None),  # future, delivered before
        ]))
    got = affected(ws, "t")
    assert {k: v for k, v in got.items() if k[0] != "NULL_CHECK"} == {
        ("AMOUNT_MISMATCH", "total_amount"): 1, ("COST_EXCEEDS_PRICE", "cost_price"): 1,
        ("FUTURE_DATE", "order_date"): 1, ("DATE_ORDERING", "delivery_date"): 1,
    }


@pytest.mark.parametrize("nulls, severity", [(1, "LOW"), (5, "LOW"), (6, "MEDIUM"), (10, "MEDIUM"), (11, "HIGH"),
                                             (20, "HIGH"), (21, "CRITICAL")])
def test_null_severity_is_strict(spark, nulls, severity):
    data = spark.range(100).select(F.when(F.col("id") >= nulls, F.col("id")).alias("v"))
    assert scan(workspace(spark, t=data), ["t"]).issues.first().severity == severity


def test_empty_table(spark):
    empty = seed.demo_workspace(spark, dt.datetime(2026, 1, 1)).tables["ORDERS"].where("false")
    ws = Workspace(spark, {"ORDERS": empty, "CUSTOMERS": spark.range(0).withColumnRenamed("id", "customer_id")},
                   seed.BINDINGS, AS_OF)
    done = scan(ws, ["ORDERS"], "catalog")
    assert done.issues.count() == 0
    scored = done.scores.collect()
    assert [(r.health_score, r.total_rows, r.issues_found) for r in scored] == [(100.0, 0, 0)]


def test_no_applicable_rule(spark):
    ws = workspace(spark, t=spark.range(3))
    assert scan(ws, ["t"], {"EMAIL_FORMAT"}).issues.count() == 0
    assert scan(ws, [], "executed").scores.count() == 0


def test_null_references_are_not_orphans(spark):
    child = literal_rows(spark, "order_id bigint, customer_id bigint", [(1, 1), (2, None), (3, 9), (4, 9)])
    parent = literal_rows(spark, "customer_id bigint", [(1,), (1,), (None,)])
    fk = ForeignKey("customer_id", "parents", "customer_id", "parents")
    ws = workspace(spark, {"t": Binding(foreign_keys=(fk,))}, t=child, parents=parent)
    assert affected(ws, "t")["ORPHAN_REFERENCE", "customer_id"] == 2


def test_declared_rules(spark):
    data = literal_rows(spark, "k_id bigint, phone string, word string, score int, born date", [
        (1, "+91-712345678", "Blue", 300, dt.date(1899, 12, 31)),
        (2, "bad", "blue", 850, dt.date(1900, 1, 1)),
        (3, None, "Blue", 851, None),
        (3, None, "Blue", 851, None),
        (4, "", " BLUE", 299, None),
    ])
    ws = workspace(spark, {"t": Binding(
        phones=("phone",), cased=("word",), ranges={"score": (300, 850)},
        date_floors={"born": dt.date(1900, 1, 1)}, freshness={"born": 30})}, t=data)
    got = affected(ws, "t", "catalog")
    assert got["PHONE_FORMAT", "phone"] == 1
    assert got["CASE_CONSISTENCY", "word"] == 2
    assert got["NUMERIC_RANGE", "score"] == 3
    assert got["DATE_RANGE", "born"] == 1
    assert got["DUPLICATE_ROW", "*"] == 2
    assert got["FRESHNESS_CHECK", "born"] == 5


def test_inactive_catalog_rules_are_silent(spark):
    data = literal_rows(spark, "k_id bigint, name string", [(None, " x")])
    issues = scan(workspace(spark, t=data), ["t"], "catalog").issues
    catalog = seed.rule_catalog(spark, dt.datetime(2024, 1, 1), inactive=("WHITESPACE_CHECK",))
    assert rows(issue_ops.with_catalog(issues, catalog), "rule_name", "severity") == [("NULL_CHECK", "HIGH")]


def test_wide_tables_are_scanned_in_chunks(spark):
    data = spark.range(10).select(*[F.when(F.col("id") > i % 3, F.col("id")).alias(f"c{i}") for i in range(250)])
    ws = workspace(spark, t=data)
    got = affected(ws, "t")
    assert len(got) == 250
    assert got["NULL_CHECK", "c2"] == 3
    assert scan(ws, ["t"]).scores.first().issues_found == 250


def fixable_workspace(spark):
    return seed.demo_workspace(spark, dt.datetime(2026, 1, 1, 12))


@pytest.mark.parametrize("table", ["CUSTOMERS", "ORDERS", "PRODUCTS"])
def test_each_fix_clears_its_rule(spark, table):
    """After all fixes of a table none of their rules fires; a second round changes nothing."""
    ws = fixable_workspace(spark)
    fixes = [b for b in ws.bound([table]) if can_fix(b)]
    fixed = apply_fixes(ws.tables[table], fixes)
    names = {b.rule.name for b in fixes} - {"NEGATIVE_VALUE"}  # recomputed amounts may be negative again
    assert [k for k in affected(ws.replacing({table: fixed}), table) if k[0] in names] == []
    again = apply_fixes(fixed, fixes)
    assert again.exceptAll(fixed).count() == fixed.exceptAll(again).count() == 0


def test_swap_uses_both_old_values(spark):
    data = literal_rows(spark, "a date, b date", [(dt.date(2024, 2, 2), dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 1))])
    ws = workspace(spark, {"t": Binding(date_pairs=(("a", "b"),))}, t=data)
    fixed = apply_fixes(data, choose(ws.bound(["t"]), "DATE_ORDERING"))
    assert set(rows(fixed)) == {(dt.date(2024, 1, 1), dt.date(2024, 2, 2)), (None, dt.date(2024, 1, 1))}


def test_fixes_run_in_report_order(spark):
    """A padded e-mail address is judged before it is trimmed, so approving both loses it."""
    data = literal_rows(spark, "email string", [(" a@b.com ",)])
    bound = workspace(spark, t=data).bound(["t"])
    both = choose(bound, "WHITESPACE") + choose(bound, "EMAIL_FORMAT")
    assert rows(apply_fixes(data, both)) == [(None,)]
    assert rows(apply_fixes(data, safe_rules(bound))) == [("a@b.com",)]


def test_deduplicate_keeps_first_and_null_keys(spark):
    data = literal_rows(spark, "k bigint, v string, n int", [
        (1, "b", 1), (1, "a", 2), (1, "a", 1), (None, "x", 1), (None, "x", 1), (2, None, 5)])
    assert rows(deduplicate(data, ["k"], ["v"])) == [(1, "a", 1), (2, None, 5), (None, "x", 1), (None, "x", 1)]
