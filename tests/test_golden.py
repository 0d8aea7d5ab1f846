"""The demo data set: counts and scores worked out by hand from its designed defects."""

import datetime as dt

import pytest

from plumbline import rules
from plumbline.operators import history
from plumbline.operators.scoring import load_weights
from plumbline.plans.cycle import before_after
from plumbline.plans.scan import AFTER, BEFORE, Workspace, compile_catalog, scan, scan_before_after
from plumbline.schemas import RULE_PREDICATES
from plumbline.sources import seed
from plumbline.sources.values import literal_rows
from tests.conftest import rows

AS_OF = dt.datetime(2026, 1, 1, 12)


@pytest.fixture(scope="module")
def demo(spark):
    return seed.demo_workspace(spark, AS_OF)


@pytest.fixture(scope="module")
def found(demo):
    return {
        (r.table_name, r.rule_name, r.column_name): r
        for r in scan(demo, list(demo.tables)).issues.collect()
    }


def test_row_counts(demo):
    assert {n: t.count() for n, t in demo.tables.items()} == {"CUSTOMERS": 5017, "PRODUCTS": 510, "ORDERS": 20022}


@pytest.mark.parametrize("table, rule, column, affected", [
    ("CUSTOMERS", "NULL_CHECK", "customer_id", 3), ("CUSTOMERS", "NULL_CHECK", "customer_segment", 5),
    ("CUSTOMERS", "NULL_CHECK", "first_name", 1), ("CUSTOMERS", "NULL_CHECK", "last_login", 2),
    ("CUSTOMERS", "BLANK_STRING", "email", 1), ("CUSTOMERS", "DUPLICATE_KEY", "customer_id", 7),
    ("CUSTOMERS", "EMAIL_FORMAT", "email", 2), ("CUSTOMERS", "NEGATIVE_VALUE", "annual_income", 1),
    ("CUSTOMERS", "FUTURE_DATE", "date_of_birth", 1), ("CUSTOMERS", "WHITESPACE", "city", 2),
    ("ORDERS", "NULL_CHECK", "order_id", 2), ("ORDERS", "DUPLICATE_KEY", "order_id", 2),
    ("ORDERS", "NEGATIVE_VALUE", "total_amount", 2), ("ORDERS", "FUTURE_DATE", "order_date", 2),
    ("ORDERS", "ORPHAN_REFERENCE", "customer_id", 5), ("ORDERS", "DATE_ORDERING", "delivery_date", 2),
    ("PRODUCTS", "NULL_CHECK", "category", 1), ("PRODUCTS", "DUPLICATE_KEY", "product_id", 2),
    ("PRODUCTS", "NEGATIVE_VALUE", "stock_quantity", 1), ("PRODUCTS", "INVALID_CATEGORY", "category", 33),
])
def test_issue_counts(found, table, rule, column, affected):
    assert found[table, rule, column].affected_rows == affected


def test_issue_totals(found):
    per_table = [key[0] for key in found]
    assert {t: per_table.count(t) for t in set(per_table)} == {"CUSTOMERS": 26, "ORDERS": 10, "PRODUCTS": 11}
    assert ("ORDERS", "AMOUNT_MISMATCH", "total_amount") not in found
    assert found["PRODUCTS", "COST_EXCEEDS_PRICE", "cost_price"].affected_rows >= 2


def test_issue_texts(found):
    assert found["CUSTOMERS", "DUPLICATE_KEY", "customer_id"].issue_description \
        == "2 duplicate customer_id values (7 rows)"
    assert found["CUSTOMERS", "NULL_CHECK", "customer_segment"].issue_description \
        == "customer_segment has 5 NULL values (0.1%)"
    assert found["ORDERS", "ORPHAN_REFERENCE", "customer_id"].issue_description \
        == "5 orders reference missing customers"


def test_scores_before_and_after(demo):
    scored = scan_before_after(demo, list(demo.tables)).scores
    got = {(r.table_name, r.phase): r for r in scored.collect()}
    dims = ("completeness", "uniqueness", "validity", "consistency", "integrity", "freshness")

    def dimensions(table, phase):
        return tuple(got[table, phase][f"{d}_score"] for d in dims)

    assert dimensions("CUSTOMERS", BEFORE) == (20.0, 71.7, 45.8, 75.8, 100.0, 100.0)
    assert dimensions("ORDERS", BEFORE) == (81.9, 72.0, 20.0, 100.0, 72.0, 100.0)
    assert dimensions("PRODUCTS", BEFORE) == (74.4, 71.2, 20.0, 100.0, 100.0, 100.0)
    assert {k: (r.health_score, r.issues_found) for k, r in got.items()} == {
        ("CUSTOMERS", BEFORE): (59.9, 26), ("ORDERS", BEFORE): (69.7, 10), ("PRODUCTS", BEFORE): (71.8, 11),
        ("CUSTOMERS", AFTER): (63.5, 21), ("ORDERS", AFTER): (69.7, 10), ("PRODUCTS", AFTER): (67.4, 10),
    }


def test_safe_fixes_can_lower_the_mean(demo):
    """A valid category missing from the allowed list is nulled by a low-risk fix."""
    compared = before_after(demo, list(demo.tables)).collect()
    assert round(sum(r.score_before for r in compared) / 3, 2) == 67.13
    assert round(sum(r.score_after for r in compared) / 3, 2) == 66.87


def test_stored_weights_make_the_score(demo):
    """Another weight table, another health score; versions of the tables keep the weights."""
    weighted = Workspace(demo.spark, demo.tables, demo.bindings, demo.as_of, {**{d: "0" for d in rules.DIMENSIONS}, "COMPLETENESS": "1.00"})
    for ws in (weighted, weighted.replacing({})):
        got = scan(ws, ["PRODUCTS"]).scores.first()
        assert got.health_score == got.completeness_score == 74.4


def test_seeded_history(spark):
    past = seed.seeded_history(spark, AS_OF.date())
    assert past.count() == 18
    assert rows(history.latest(past), "table_name") == [("CUSTOMERS",), ("ORDERS",), ("PRODUCTS",)]
    trend = history.trend(past).collect()
    assert [(r.score, r.issues, r.rows_at_risk) for r in trend][0] == (64.17, 56, 8500)
    assert history.trust_delta(past).first().delta == 21.67
    change = history.trust_change(past).first()
    assert change.message == "Trust improved +1.6 pts. Issues: 18 → 15"
    kpis = history.kpis(past).first()
    assert (kpis.health_score, kpis.tables, kpis.issues, kpis.critical, kpis.rows_at_risk) == (85.83, 3, 15, 2, 2000)
    dims = {r.dimension: r.score for r in history.mean_dimensions(past).collect()}
    assert dims["COMPLETENESS"] == 84.67 and dims["FRESHNESS"] == 94.33


def test_trend_directions(spark):
    past = seed.seeded_history(spark, AS_OF.date())
    backwards = past.withColumn("health_score", past.health_score * -1 + 150)
    assert history.trust_change(backwards).first().message.startswith("Trust dropped -1.6 pts.")
    one_day = past.where("scan_id = 'HIST_06'")
    assert history.trust_change(one_day).count() == 0
    flat = past.withColumn("health_score", past.health_score * 0 + 80)
    assert history.trust_change(flat).first().message == "Stable since last scan."


def test_inactive_rules_are_not_counted(demo):
    catalog = seed.rule_catalog(demo.spark, AS_OF, ("NULL_CHECK", "OWN"), (("OWN", "VALIDITY", "x", "NUMBER", "LOW"), ("KEPT", "VALIDITY", "x", "NUMBER", "LOW")))
    predicates = literal_rows(demo.spark, RULE_PREDICATES, [
        ("OWN", "PRODUCTS", "unit_price", "unit_price > 1"), ("KEPT", "PRODUCTS", "unit_price", "unit_price IS NULL OR unit_price > 0"),
        ("KEPT", "PRODUCTS", "unit_price", "sum(unit_price) > 1"), ("KEPT", "ORDERS", "quantity", "quantity > 1")])
    names, own = compile_catalog(demo, catalog, predicates, ["PRODUCTS"])
    assert "NULL_CHECK" not in names and "BLANK_STRING" in names and [b.rule.name for b in own] == ["KEPT"]
    done = scan(demo, ["PRODUCTS"], names, own=own)
    assert {b.rule.name for b in done.rules} <= names | {"KEPT"}
    assert done.issues.where("rule_name = 'KEPT'").first().affected_rows > 0


def test_rule_catalog_and_weights(spark):
    assert seed.rule_catalog(spark, AS_OF).count() == 16
    assert load_weights(seed.score_weights(spark)) == rules.WEIGHTS
