"""Quality contracts: predicates written by users, checked against their table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from plumbline.operators.rowscan import MAX_COUNTERS
from plumbline.schemas import QUALITY_CONTRACTS
from plumbline.sources.values import literal_rows

NAME_LENGTH = 100
EVALUATED = (
    "contract_id bigint, table_name string, natural_language_rule string, severity string, created_at timestamp_ntz, "
    "violations bigint, status string"
)
PASSING, VIOLATED, CANNOT_EVALUATE = "PASSING", "VIOLATIONS", "CANNOT EVALUATE"


def contract(
    contract_id: int, table: str, rule: str, predicate: str, severity: str = "HIGH",
    created_at: dt.datetime | None = None, created_by: str = "", is_active: bool = True,
) -> tuple:
    """A contract row; `predicate` is an SQL expression that is true on a violating row."""
    return (contract_id, rule[:NAME_LENGTH], table, "MULTI", rule, predicate, severity, is_active,
            created_by, created_at)


def contract_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return literal_rows(spark, QUALITY_CONTRACTS, rows)


def active_contracts(contracts: DataFrame) -> DataFrame:
    return contracts.where("is_active").orderBy(F.desc("created_at"), F.desc("contract_id"))


def _violations(predicate: str):
    """The count of rows for which a predicate holds. A line feed ends a comment in the text."""
    return F.count_if(F.expr(f"(\n{predicate}\n)"))


def is_valid(df: DataFrame, predicate: str) -> bool:
    """Whether the text is one boolean expression over the columns of a row, as it is going to be
    counted: aggregates, windows and subqueries are refused. Runs nothing."""
    try:
        boolean = isinstance(df.select(F.expr(f"(\n{predicate}\n)")).schema[0].dataType, T.BooleanType)
        # Only an expression over single rows can be a filter and be counted.
        return boolean and bool(df.where(F.expr(predicate)).agg(_violations(predicate)).columns) and not _has_subquery(df, predicate)
    except PySparkException:
        return False


def _has_subquery(df: DataFrame, predicate: str) -> bool:
    """Whether the parsed expression, not its text, looks at other rows."""
    filtered = df.where(F.expr(f"(\n{predicate}\n)"))._jdf.queryExecution().analyzed()
    return not filtered.subqueries().isEmpty()


def _suspects(error: PySparkException, rows: Sequence[Row]) -> list[Row]:
    """The contracts that hold the piece of text at which a pass failed."""
    pieces = {c.fragment() for c in error.getQueryContext() if c.contextType().name == "SQL"}
    return [r for r in rows if any(piece in r.generated_sql_check for piece in pieces if piece)]


def _tally(df: DataFrame, rows: Sequence[Row]) -> dict[int, int | None]:
    """Violations by contract, in one pass over the table. If the pass fails (a cast, a division), the
    error names the expression: the contracts that hold it are tried by themselves and the others
    together again, so a failing contract costs one more pass. Without a name the halves are tried."""
    try:
        counts = df.agg(*[_violations(r.generated_sql_check).alias(f"v_{r.contract_id}") for r in rows]).first()
        return {r.contract_id: counts[f"v_{r.contract_id}"] for r in rows}
    except PySparkException as error:
        if len(rows) == 1:
            return {rows[0].contract_id: None}
        suspects = _suspects(error, rows)
    if len(suspects) == 1:
        return {suspects[0].contract_id: None} | _tally(df, [r for r in rows if r != suspects[0]])
    half = [r for r in rows if r in suspects] if 0 < len(suspects) < len(rows) else rows[:len(rows) // 2]
    return _tally(df, half) | _tally(df, [r for r in rows if r not in half])


def evaluate(contracts: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of every active contract, counted now, all contracts of a table in one pass (in
    chunks of `MAX_COUNTERS`).

    The contract list itself is configuration and read to build the plan; what comes back is one
    count per contract. A contract whose text is no valid predicate, whose table is missing or that
    fails while it runs gets a status, not an error, and leaves the others alone.
    """
    rows = active_contracts(contracts).collect()
    found: dict[int, int | None] = {}
    for name in sorted({r.table_name for r in rows} & set(tables)):
        df = tables[name]
        valid = [r for r in rows if r.table_name == name and is_valid(df, r.generated_sql_check)]
        for start in range(0, len(valid), MAX_COUNTERS):
            found |= _tally(df, valid[start:start + MAX_COUNTERS])
    return literal_rows(contracts.sparkSession, EVALUATED, [
        (r.contract_id, r.table_name, r.natural_language_rule, r.severity, r.created_at,
         found.get(r.contract_id), _status(found.get(r.contract_id)))
        for r in rows
    ])


def _status(violations: int | None) -> str:
    if violations is None:
        return CANNOT_EVALUATE
    return VIOLATED if violations else PASSING
