"""The persisted round: results, history, issues, log, snapshots."""

import datetime as dt
from decimal import Decimal

import pytest

from plumbline import schemas
from plumbline.operators import history, records
from plumbline.binding import Binding
from plumbline.operators.fixes import apply_fixes, safe_rules, undo
from plumbline.plans.cycle import approve, before_after, remediation_log, run_cycle
from plumbline.plans.scan import Workspace
from plumbline.sources import seed
from plumbline.sources.store import SHARED_FOLDER, Store, shared_folder
from plumbline.sources.values import literal_rows
from pyspark.sql.types import StructType
from tests.conftest import rows

AS_OF = dt.datetime(2026, 1, 1, 12)
NAMES = ["CUSTOMERS", "ORDERS", "PRODUCTS"]


@pytest.fixture(scope="module")
def demo(spark):
    return seed.demo_workspace(spark, AS_OF)


@pytest.fixture(scope="module")
def done(spark, demo):
    store = Store(spark, shared_folder(spark, "cycle"))
    compared = run_cycle(demo, NAMES, store, "steward", AS_OF)
    return store, rows(compared, "table_name", "score_before", "score_after", "issues_before", "issues_after")


def test_persisted_round_equals_the_preview(demo, done):
    assert done[1] == rows(
        before_after(demo, NAMES), "table_name", "score_before", "score_after", "issues_before", "issues_after")


def test_results_and_history(done):
    store, _ = done
    results = store.read("scan_results")
    assert results.count() == 6
    stored = StructType.fromDDL(schemas.SCAN_RESULTS)
    assert [results.schema[f.name].dataType for f in stored] == [f.dataType for f in stored]
    newest = records.newest_scans(results).collect()
    assert [r.table_name for r in newest[:3]] == NAMES and newest[0].scan_timestamp > newest[-1].scan_timestamp
    past = store.read("health_score_history")
    assert history.kpis(past).first().tables == 6  # both scans of the day count as latest
    per_table = history.latest_per_table(past)
    assert rows(per_table, "table_name", "total_issues") == [("CUSTOMERS", 21), ("ORDERS", 10), ("PRODUCTS", 10)]


def test_a_repeated_run_replaces_its_rows(spark, demo):
    store = Store(spark, shared_folder(spark, "repeated"))
    for _ in range(2):
        run_cycle(demo, ["PRODUCTS"], store, "steward", AS_OF)
    assert store.read("scan_results").count() == 2
    assert store.read("remediation_log").count() == 1
    assert store.read("health_score_history").schema["scan_date"].dataType.simpleString() == "date"


def test_issue_ids_are_unique(done):
    issues = done[0].read("scan_issues")
    assert issues.count() == 47 + 41 == issues.select("issue_id").distinct().count()


def test_remediation_log(done):
    log = done[0].read("remediation_log")
    got = {(r.table_name, r.issue_type, r.column_name): r for r in log.collect()}
    assert set(got) == {
        ("CUSTOMERS", "BLANK_STRING", "email"), ("CUSTOMERS", "WHITESPACE", "first_name"),
        ("CUSTOMERS", "WHITESPACE", "last_name"), ("CUSTOMERS", "WHITESPACE", "city"),
        ("CUSTOMERS", "WHITESPACE", "state"), ("PRODUCTS", "INVALID_CATEGORY", "category"),
    }
    entry = got["PRODUCTS", "INVALID_CATEGORY", "category"]
    assert (float(entry.before_score), float(entry.after_score)) == (71.8, 67.4)
    assert (entry.approval_status, entry.approved_by, entry.execution_result) == ("EXECUTED", "steward", "SUCCESS")
    assert records.newest_remediations(log).count() == 6


def test_a_round_that_is_cut_short_leaves_nothing(spark, demo, monkeypatch):
    store = Store(spark, shared_folder(spark, "cut"))
    tables = ("scan_results", "scan_issues", "health_score_history", "remediation_log", "fix_images")
    with monkeypatch.context() as patch:
        patch.setattr(records, "remediation_rows", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_cycle(demo, ["PRODUCTS"], store, "steward", AS_OF)
    assert [store.read(t).count() for t in tables] == [0] * 5
    run_cycle(demo, ["PRODUCTS"], store, "steward", AS_OF)
    assert [store.read(t).count() > 0 for t in tables] == [True] * 5
    assert store.read_fixed("PRODUCTS").count() == demo.tables["PRODUCTS"].count()


def test_images_say_what_each_fix_did(spark, demo, done):
    store = done[0]
    images = store.read("fix_images")
    logged = {(r.table_name, r.issue_type, r.column_name): r.affected_rows for r in store.read("remediation_log").collect()}
    counted = images.groupBy("table_name", "rule_name", "column_name").count().collect()
    assert {(r.table_name, r.rule_name, r.column_name): r["count"] for r in counted} == {k: n for k, n in logged.items() if n}
    blank = images.where("rule_name = 'BLANK_STRING'").first()
    assert [tuple(c) for c in blank.changes] == [("email", "", None)]


def test_one_fix_is_undone_alone(spark, demo, done):
    store = done[0]
    fixed, original = store.read_fixed("CUSTOMERS"), demo.tables["CUSTOMERS"]
    undone = undo(fixed, store.read("fix_images").where("table_name = 'CUSTOMERS'"), ["customer_id"], "WHITESPACE", "city")
    assert undone.schema.names == original.schema.names
    once = original.groupBy("customer_id").count().where("count = 1").select("customer_id")
    assert rows(undone.join(once, "customer_id").select("customer_id", "city")) == rows(original.join(once, "customer_id").select("customer_id", "city"))
    assert rows(undone.select("customer_id", "first_name")) == rows(fixed.select("customer_id", "first_name"))


def test_a_failing_fix_is_logged_beside_good_ones(spark):
    amounts = literal_rows(spark, "order_id bigint, total_amount decimal(4,2), quantity bigint, unit_price decimal(10,2), note string", [
        (1, Decimal("1.00"), 1000, Decimal("99999.00"), " padded "), (2, Decimal("2.00"), 1, Decimal("2.00"), "x")])
    ws = Workspace(spark, {"T": amounts}, {"T": Binding(amounts=(("total_amount", "quantity", "unit_price"),))}, AS_OF)
    store = Store(spark, shared_folder(spark, "failing"))
    run_cycle(ws, ["T"], store, "steward", AS_OF)
    got = {r.issue_type: (r.affected_rows, r.execution_result) for r in store.read("remediation_log").collect()}
    assert got["WHITESPACE"] == (1, "SUCCESS")
    assert got["AMOUNT_MISMATCH"][0] == 0 and got["AMOUNT_MISMATCH"][1].startswith("FAILED: ")
    assert store.read_fixed("T").where("note = 'padded'").count() == 1


def test_previews_say_that_nothing_was_run(demo):
    log = remediation_log(demo, ["PRODUCTS"], "steward").first()
    assert (log.approval_status, log.execution_result, log.executed_at) == ("PREVIEW", "NOT RUN", None)


def test_snapshots_allow_rollback(spark, demo):
    store = Store(spark, shared_folder(spark, "snapshots"))
    first = store.write_snapshot("CUSTOMERS", "v1", demo.tables["CUSTOMERS"])
    store.write_snapshot("CUSTOMERS", "v2", apply_fixes(first, safe_rules(demo.bound(["CUSTOMERS"]))))
    assert store.read_snapshot("CUSTOMERS", "v2").where("email = ''").count() == 0
    assert store.read_snapshot("CUSTOMERS", "v1").where("email = ''").count() == 1


def test_one_approved_fix_is_logged(demo):
    fixed, log = approve(demo, "CUSTOMERS", "NEGATIVE_VALUE", ["annual_income"], "steward")
    assert fixed.where("annual_income < 0").count() == 0
    entry = log.first()
    assert (entry.issue_type, entry.affected_rows, entry.before_score) == ("NEGATIVE_VALUE", 1, 59.9)
    assert entry.after_score > entry.before_score


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get(SHARED_FOLDER, None)
    folder = shared_folder(spark, "x")
    assert folder != shared_folder(spark, "x")
    assert named is None or folder.startswith(named)
