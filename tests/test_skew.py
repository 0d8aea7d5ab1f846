"""One key holds a third of all rows: results stay whole and no task gets them all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.binding import Binding, ForeignKey, ParentDate
from plumbline.operators import salting
from plumbline.operators.fixes import deduplicate
from plumbline.operators.keyed import duplicate_rows
from plumbline.operators.risk import distinct_rows_at_risk
from plumbline.operators.violations import orphan_rows
from plumbline.plans.scan import Workspace, scan
from tests.conftest import rows

N = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    """order 0 holds a third of the rows, names a missing customer and precedes its parent."""
    i = F.col("id")
    child = spark.range(N).select(
        F.when(i % 3 == 0, 0).otherwise(i).alias("order_id"),
        F.when(i % 3 == 0, -1).otherwise(i % 100).alias("customer_id"),
        F.expr("DATE'2024-01-01'").alias("shipped"),
        (i % 5).alias("quantity"),
    )
    parents = spark.range(100).select(F.col("id").alias("customer_id"))
    orders = spark.range(N).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") == 0, F.expr("DATE'2024-02-01'")).otherwise(F.expr("DATE'2023-12-01'")).alias("ordered"))
    binding = Binding(
        foreign_keys=(ForeignKey("customer_id", "parents", "customer_id", "customers"),),
        parent_dates=(ParentDate("shipped", "order_id", "orders", "order_id", "ordered"),),
    )
    return Workspace(spark, {"t": child, "parents": parents, "orders": orders}, {"t": binding}, dt.date(2024, 6, 1))


@pytest.fixture(params=[(salting.BROADCAST_BYTES, salting.HOT_ROWS), (0, salting.HOT_ROWS), (0, 100)],
                ids=["few keys", "many keys", "hot keys"])
def key_limit(request, monkeypatch):
    """All ways of joining: broadcast keys, a shuffle, and a shuffle with salted hot keys."""
    monkeypatch.setattr(salting, "BROADCAST_BYTES", request.param[0])
    monkeypatch.setattr(salting, "HOT_ROWS", request.param[1])


def test_counts(hot):
    got = {r.rule_name: (r.affected_rows, r.duplicate_groups) for r in scan(hot, ["t"], "executed").issues.collect()}
    assert got == {"DUPLICATE_KEY": (10_000, 1), "ORPHAN_REFERENCE": (10_000, 0), "DATE_ORDERING": (10_000, 0)}


def test_orphan_rows(hot, key_limit):
    fk = hot.binding("t").foreign_keys[0]
    lost = orphan_rows(hot.tables["t"], fk, hot.tables["parents"], ["order_id", "quantity"])
    assert lost.count() == 10_000 and rows(lost.select("customer_id").distinct()) == [(-1,)]


def test_rows_at_risk_count_once(hot, key_limit):
    risk = distinct_rows_at_risk(hot.tables["t"], "t", hot.bound(["t"]), hot.tables).first()
    assert (risk.rows_at_risk, risk.total_rows) == (10_000, N)


def test_rows_at_risk_add_up(hot, key_limit):
    """Rows with a bad quantity that are neither copies nor orphans come on top."""
    spoiled = hot.tables["t"].withColumn("quantity", F.when(F.col("order_id") == 7, -1).otherwise(F.col("quantity")))
    ws = hot.replacing({"t": spoiled})
    assert distinct_rows_at_risk(spoiled, "t", ws.bound(["t"]), ws.tables).first().rows_at_risk == 10_001


def test_duplicate_rows(hot, key_limit):
    got = rows(duplicate_rows(hot.tables["t"]), "order_id", "quantity", "n_rows")
    assert got == [(0, q, 2000) for q in range(5)]


def test_deduplicate(hot, key_limit):
    kept = deduplicate(hot.tables["t"], ["order_id"], ["quantity"])
    assert kept.count() == 20_001
    assert rows(kept.where("order_id = 0"), "quantity") == [(0,)]


def test_salting_spreads_a_hot_key(hot):
    """As many salts as the key's rows ask for, and all of them used."""
    for salts in (4, 16):
        spread = hot.tables["t"].where("order_id = 0").withColumn("i", F.monotonically_increasing_id()).select(
            salting._salt(["quantity", "i"], F.lit(salts)).alias("s")).distinct().count()
        assert spread == salts


def test_wide_keys_are_not_broadcast(spark):
    """Few keys may be large: their bytes decide, and the rows found are the same."""
    wide = F.concat(F.repeat(F.lit("x"), 16_000), F.col("id").cast("string"))
    keys = spark.range(900).select(wide.alias("k"), F.lit(2).cast("long").alias("n_rows"))
    assert not salting.settled(keys)[1] and salting.settled(keys.select(F.substring("k", -4, 4).alias("k")))[1]
    table = spark.range(1000).select(wide.alias("k"), "id")
    found = salting.keep_matching(table.unionAll(table), keys, ["id"])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    assert found.agg(F.count("id"), F.countDistinct("id")).first() == (1800, 900)


def test_hot_text_keys_are_found_whole(spark, monkeypatch):
    monkeypatch.setattr(salting, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(salting, "HOT_ROWS", 50)
    table = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.repeat(F.lit("h"), 500)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    keys = table.groupBy("k").agg(F.count("id").alias("n_rows")).where("k LIKE 'h%' OR k LIKE '1%'")
    wanted = table.where("k LIKE 'h%' OR k LIKE '1%'").count()
    found = salting.keep_matching(table, keys, ["id"])
    assert found.agg(F.count("id"), F.countDistinct("id")).first() == (wanted, wanted)
    flagged = salting.flag_matching(table, keys, ["id"], "hit").groupBy("hit").count()
    assert rows(flagged) == [(False, 3000 - wanted), (True, wanted)]


def test_duplicate_rows_with_maps(spark):
    table = spark.sql("SELECT id % 2 AS a, map('k', id % 2, 'l', 1) AS m FROM range(5) UNION ALL SELECT 7, map('k', 1)")
    assert rows(duplicate_rows(table), "a", "n_rows") == [(0, 3), (1, 2)]
