"""The shape of physical plans: what is read, how often, and what is never done."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.config import AS_OF, SCANNED, open_workspace
from plumbline.operators.profile import profile_columns
from plumbline.operators.violations import orphan_keys
from plumbline.plans.registry import QUERIES, past_scores
from plumbline.plans.scan import scan, scan_before_after

RUNS_JOBS = {"fix_rollback", "run_cycle"} | {name for name in QUERIES if name.startswith("stream_")}


@pytest.fixture(scope="module")
def ws(spark, data_dir):
    return open_workspace(spark, data_dir)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_JOBS))
def test_no_cross_joins_or_python(spark, data_dir, name):
    text = plan(QUERIES[name](spark, data_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in text


def test_row_rules_share_one_scan(ws):
    row_rules = {"NULL_CHECK", "BLANK_STRING", "EMAIL_FORMAT", "NEGATIVE_VALUE", "FUTURE_DATE", "INVALID_CATEGORY",
                 "WHITESPACE"}
    assert plan(scan(ws, ["customer_dirty"], row_rules).issues).count("FileScan") == 1


def test_before_and_after_share_their_scans(ws):
    once = final_plan(scan(ws, SCANNED).scores)
    both = final_plan(scan_before_after(ws, SCANNED).scores)
    assert len(re.findall("FileScan parquet", both)) == len(re.findall("FileScan parquet", once))


def test_key_rules_read_only_their_columns(ws):
    text = plan(scan(ws, ["lineitem"], {"DUPLICATE_KEY"}).issues)
    assert re.findall(r"ReadSchema: (\S+)", text) == ["struct<l_orderkey:bigint,l_linenumber:int>"]


def test_distinct_values_of_all_columns_share_a_scan(ws):
    text = final_plan(profile_columns(ws.tables["lineitem"], "lineitem"))
    assert text.count("FileScan") == 1 and len(re.findall(r"ShuffleQueryStage", text)) <= 2


def test_violation_filters_reach_the_scan(spark, data_dir):
    text = plan(QUERIES["violations_cost"](spark, data_dir))
    assert "Exchange" not in text
    assert "PushedFilters: [IsNotNull(p_partkey)" in text or "PushedFilters: [IsNotNull(p_retailprice)" in text


def test_fixes_need_no_shuffle(spark, data_dir):
    for name in ("fix_blank_string", "fix_date_swap", "fix_amount"):
        assert "Exchange" not in plan(QUERIES[name](spark, data_dir))


def test_the_history_holds_every_row_in_one_scan(ws):
    """Undated and later rows and tables without a date belong to the scan of today."""
    scanned = past_scores(ws, "year").groupBy("table_name").agg(
        F.sum("total_rows").alias("n"), F.max("scan_date").alias("last")).collect()
    assert {r.table_name: r.n for r in scanned} == {name: ws.tables[name].count() for name in SCANNED}
    assert all(r.last <= AS_OF for r in scanned)


def test_references_are_counted_before_they_meet_the_parent(ws):
    """The optimizer must not move the lookup below the counting (it would, for an anti-join)."""
    fk = ws.binding("lineitem").foreign_keys[0]
    text = plan(orphan_keys(ws.tables["lineitem"], fk, ws.tables["orders"]))
    join = re.search(r"^.*Join \[l_orderkey.*$", text, re.M)
    assert "partial_count" in text[join.end():] and "count" not in text[:join.start()].replace("partial_count", "")
