"""Rounding, quantiles and rows at risk against straightforward computations."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.functions.numbers import dimension_band, half_up, health_band, percent
from plumbline.operators import quantiles
from plumbline.operators.keyed import outlier_fences
from plumbline.operators.profile import (
    profile_column, profile_columns, profile_numeric, profile_text, top_values,
)
from plumbline.operators.quantiles import exact_quantiles
from plumbline.sources.tables import catalog_tables, row_counts
from plumbline.sources.values import literal_rows


@settings(max_examples=10, deadline=None)
@given(pairs=st.lists(st.tuples(st.integers(0, 10**12), st.integers(0, 10**12)), min_size=20, max_size=60))
def test_half_up_is_exact(spark, pairs):
    data = literal_rows(spark, "a bigint, b bigint", pairs)
    got = data.select("a", "b", half_up(F.col("a"), F.col("b"), 2).alias("r")).collect()
    for r in got:
        wanted = Decimal(0) if r.b == 0 else (Decimal(r.a) / r.b).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert r.r == float(wanted)


def test_percent_and_bands(spark):
    data = literal_rows(spark, "n bigint, t bigint", [(1, 8), (1, 3), (0, 0), (5, 5)])
    assert [r[0] for r in data.select(percent(F.col("n"), F.col("t"))).collect()] == [12.5, 33.33, 0.0, 100.0]
    scores = literal_rows(spark, "s double", [(85.0,), (84.9,), (70.0,), (50.0,), (49.9,), (80.0,), (60.0,)])
    got = {r[0]: (r[1], r[2]) for r in scores.select("s", health_band(F.col("s")), dimension_band(F.col("s"))).collect()}
    assert got == {85.0: ("green", "green"), 84.9: ("blue", "green"), 70.0: ("blue", "orange"),
                   50.0: ("orange", "red"), 49.9: ("red", "red"), 80.0: ("blue", "green"), 60.0: ("orange", "orange")}


def as_column(spark, values, partitions=7):
    return literal_rows(spark, "v double", [(v,) for v in values]).repartition(partitions)


@pytest.mark.parametrize("name, values", [
    ("single", [3.5]),
    ("pair", [1.0, 2.0]),
    ("uniform", [random.Random(1).random() for _ in range(20000)]),
    ("heavy value", [5.0] * 9000 + [float(i) for i in range(9000)] + [None] * 500),
    ("far outlier", [float(i % 97) for i in range(9999)] + [1e18, -1e18]),
    ("two values", [0.0] * 5001 + [1.0] * 5000),
    ("lognormal", list(np.exp(np.random.default_rng(3).normal(0, 4, 30000)))),
])
def test_quantiles_are_exact(spark, name, values):
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {r.prob: r.value for r in exact_quantiles(as_column(spark, values), ["v"], probs).collect()}
    kept = [v for v in values if v is not None]
    for prob in probs:
        assert got[prob] == pytest.approx(np.quantile(kept, prob), rel=1e-12, abs=1e-12)


def test_quantiles_rank_nan_last_and_keep_infinities(spark):
    nan, inf = math.nan, math.inf
    for values in ([1.0, 2.0, nan, nan, nan], [1.0, 2.0, 3.0, nan], [-inf, 1.0, 2.0, inf], [inf, inf, 1.0],
                   [-inf, -inf, nan], [nan], [float(i) for i in range(500)] + [nan] * 20 + [inf] * 20 + [-inf] * 20):
        probs = (0.0, 0.25, 0.5, 0.75, 1.0)
        got = {r.prob: r.value for r in exact_quantiles(as_column(spark, values), ["v"], probs).collect()}
        wanted = as_column(spark, values).selectExpr(f"percentile(v, array{probs}) AS p").first().p
        assert [got[p] for p in probs] == pytest.approx(wanted, nan_ok=True), values


def test_a_gap_in_the_values_does_not_fill_one_slice(spark):
    """Half of the values near zero, half far away: slices hold about equally many values."""
    rng = random.Random(11)
    values = [rng.random() for _ in range(20000)] + [1e9 + rng.random() for _ in range(20000)]
    found = exact_quantiles(as_column(spark, values, 20), ["v"], (0.5,))
    assert found.first().value == pytest.approx(np.quantile(values, 0.5), rel=1e-12)


def test_quantiles_descend_to_single_values(spark, monkeypatch):
    """With hardly anything to sort, the rounds go on to single keys."""
    monkeypatch.setattr(quantiles, "GATHERED", 2)
    normal = list(np.random.default_rng(5).normal(0, 1, 4000))
    for values in (normal, [0.0, -0.0, 1e-300, 5e-324] * 40 + [-1.0] * 7, [1e18, 1.0] * 50):
        got = {r.prob: r.value for r in exact_quantiles(as_column(spark, values, 20), ["v"], (0.1, 0.5, 0.9)).collect()}
        for prob, value in got.items():
            assert value == pytest.approx(np.quantile(values, prob), rel=1e-12)


def test_quantiles_keep_every_digit(spark, monkeypatch):
    big = 9007199254740993
    rows_ = [(big + i, Decimal(f"{10 ** 32 + i}E-2"), -i) for i in range(-20, 21)] + [(None, None, None)]
    df = literal_rows(spark, "a bigint, b decimal(38,2), c int", rows_).repartition(5)
    for gathered in (1, 100):
        monkeypatch.setattr(quantiles, "GATHERED", gathered)
        got = {(r.column_name, r.prob): r.exact for r in exact_quantiles(df, ["a", "b", "c"], (0.5, 0.9, 0.4125)).collect()}
        assert got["a", 0.5] == f"{big}.0000" and got["b", 0.5] == f"{10 ** 30}.0000" and got["c", 0.5] == "0.0000"
        assert got["a", 0.9] == f"{big + 16}.0000" and got["c", 0.9] == "16.0000"
        assert got["a", 0.4125] == f"{big - 4}.5000" and got["b", 0.4125] == f"{10 ** 30 - 1}.9650" and got["c", 0.4125] == "-3.5000"
    medians = profile_numeric(df.select("a"), "t").first()
    assert medians.median_exact == f"{big}.0000"


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(as_column(spark, [None, None]), ["v"], (0.5,)).count() == 0


def test_outlier_fences(spark):
    fences = outlier_fences(as_column(spark, [1.0, 2.0, 4.0, 8.0]), ["v"]).first()
    assert (fences.low, fences.high) == (1.75 - 1.5 * 3.25, 5.0 + 1.5 * 3.25)


def test_sketched_profile_is_close(spark):
    data = spark.range(20000).select(F.col("id"), (F.col("id") % 7).alias("small"))
    exact = {r.column_name: r.distinct_count for r in profile_columns(data, "t").collect()}
    close = {r.column_name: r.distinct_count for r in profile_columns(data, "t", exact=False).collect()}
    assert exact == {"id": 20000, "small": 7}
    assert close["small"] == 7 and abs(close["id"] - 20000) < 2000


def test_top_values_break_ties_by_value(spark):
    data = literal_rows(spark, "s string", [(v,) for v in "ccbbaadefg"] + [(None,)] * 5)
    assert [r.value for r in top_values(data, "t", 4).collect()] == ["a", "b", "c", "d"]


def test_profile_depends_on_type(spark):
    data = literal_rows(spark, "n int, s string, d date, b boolean", [(1, "x", None, True), (3, None, None, False)])
    said = {c: profile_column(data, "t", c) for c in data.columns}
    assert {c: sorted(found) for c, found in said.items()} == {
        "n": ["column", "numeric"], "s": ["column", "text", "top_values"], "d": ["column"], "b": ["column"]}
    assert said["n"]["numeric"].first().median_value == 2.0
    assert said["d"]["column"].first().null_pct == 100.0


def test_catalog_tables_are_listed(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS listed")
    for name, n in (("zeta", 3), ("alpha", 5)):
        spark.range(n).write.mode("overwrite").saveAsTable(f"listed.{name}")
    spark.range(1).createOrReplaceTempView("passing")
    counted = row_counts(catalog_tables(spark, "listed")).collect()
    assert [tuple(r) for r in counted] == [("alpha", 5, 1), ("zeta", 3, 1)]
    spark.sql("DROP DATABASE listed CASCADE")


def test_profiles_without_such_columns(spark):
    words = literal_rows(spark, "s string", [("x",)])
    numbers = literal_rows(spark, "n int", [(1,)])
    assert profile_numeric(words, "t").count() == profile_text(numbers, "t").count() == top_values(numbers, "t").count() == 0
    assert profile_numeric(words, "t").columns == profile_numeric(numbers, "t").columns
    assert profile_text(numbers, "t").columns == profile_text(words, "t").columns
    assert top_values(numbers, "t").columns == top_values(words, "t").columns


def test_profile_of_an_empty_table(spark):
    empty = literal_rows(spark, "n int, s string", [])
    for r in profile_columns(empty, "t").collect():
        assert (r.total_rows, r.null_pct, r.distinct_count, r.uniqueness_pct) == (0, 0.0, 0, 0.0)
    assert profile_numeric(empty, "t").first().median_value is None
    said = profile_text(empty, "t").first()
    assert said.min_length is None and said.avg_length is None
