import datetime as dt

from plumbline.operators import contracts as c
from plumbline.sources.values import literal_rows
from tests.conftest import rows


def table(spark, *rules):
    return c.contract_table(spark, [
        c.contract(i, "t", text, predicate, created_at=dt.datetime(2024, 1, i)) for i, (text, predicate) in
        enumerate(rules, start=1)])


def test_evaluation(spark):
    data = literal_rows(spark, "a int, s string", [(1, "x"), (-1, "y"), (None, "z")])
    contracts = table(spark, ("positive", "a <= 0"), ("short", "length(s) > 5"), ("typo", "b > 1"),
                      ("not a test", "a + 1"), ("a statement", "a > 0; DROP TABLE t"), ("two tests", "a < 0 OR a > 0"))
    got = rows(c.evaluate(contracts, {"t": data}), "contract_id", "violations", "status")
    assert got == [(1, 1, "VIOLATIONS"), (2, 0, "PASSING"), (3, None, "CANNOT EVALUATE"),
                   (4, None, "CANNOT EVALUATE"), (5, None, "CANNOT EVALUATE"), (6, 2, "VIOLATIONS")]


def test_missing_table_and_no_contracts(spark):
    assert rows(c.evaluate(table(spark, ("x", "a > 1")), {}), "status") == [("CANNOT EVALUATE",)]
    assert c.evaluate(c.contract_table(spark, []), {}).count() == 0


def test_a_failing_contract_does_not_take_the_others_down(spark):
    data = literal_rows(spark, "a int, s string", [(1, "x"), (0, "7")])
    contracts = table(
        spark, ("positive", "a <= 0"), ("number", "CAST(s AS INT) > 5"), ("note", "a > 0 -- not zero"),
        ("ratio", "10 / a > 1"), ("total", "count(1) > 0"), ("window", "lag(a) OVER (ORDER BY s) > 0"),
        ("present", "s IS NULL"))
    got = sorted((r.contract_id, r.violations, r.status) for r in c.evaluate(contracts, {"t": data}).collect())
    lost = "CANNOT EVALUATE"
    assert got == [(1, 1, "VIOLATIONS"), (2, None, lost), (3, 1, "VIOLATIONS"), (4, None, lost), (5, None, lost),
                   (6, None, lost), (7, 0, "PASSING")]


def test_a_failing_contract_costs_one_more_pass(spark, monkeypatch):
    data = literal_rows(spark, "a int, s string", [(1, "(select one)"), (0, "with")])
    contracts = c.contract_table(spark, [c.contract(i, "t", "x", f"a < {i}") for i in range(40)] + [
        c.contract(50, "t", "x", "10 / a > 1"), c.contract(51, "t", "x", "CAST(s AS INT) > 1"), c.contract(52, "t", "x", "s = '(select one)'"),
        c.contract(53, "t", "x", "a IN (SELECT 1)"), c.contract(54, "t", "x", "EXISTS (WITH w AS (SELECT 1) SELECT * FROM w)")])
    passes, whole = [], c._tally
    monkeypatch.setattr(c, "_tally", lambda df, rows: passes.append(len(rows)) or whole(df, rows))
    got = {r.contract_id: r.violations for r in c.evaluate(contracts, {"t": data}).collect()}
    assert {i for i, n in got.items() if n is None} == {50, 51, 53, 54} and got[52] == 1 and got[1] == 1 and got[2] == 2
    assert len(passes) == 3


def test_many_contracts_are_counted_in_chunks(spark):
    data = literal_rows(spark, "a int", [(1,), (0,)])
    contracts = c.contract_table(spark, [c.contract(i, "t", "x", f"a < {i % 3}") for i in range(c.MAX_COUNTERS + 20)])
    got = {r.contract_id: r.violations for r in c.evaluate(contracts, {"t": data}).collect()}
    assert got == {i: i % 3 for i in range(c.MAX_COUNTERS + 20)}


def test_names_are_cut_and_newest_come_first(spark):
    contracts = table(spark, ("x" * 150, "a > 1"), ("second", "a > 1"))
    listed = c.active_contracts(contracts).collect()
    assert [r.contract_id for r in listed] == [2, 1]
    assert len(listed[1].contract_name) == 100 and len(listed[1].natural_language_rule) == 150
    assert listed[0].column_name == "MULTI"
