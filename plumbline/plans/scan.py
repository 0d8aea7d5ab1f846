"""Scanning: bind the rules of the chosen tables, count every violation, grade and score."""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.binding import Binding, BoundRule, ForeignKey, ParentDate, bind, col, key_columns, type_family
from plumbline.operators import issues as issue_ops, keyed, scoring
from plumbline.operators.contracts import is_valid
from plumbline.operators.fixes import apply_fixes, safe_rules
from plumbline.operators.rowscan import COUNTER_COLUMNS, CURRENT, count_row_rules
from plumbline.rules import RULES, WEIGHTS, Rule
from plumbline.sources.values import literal_rows

BEFORE, AFTER = "before", "after"
ORIGINAL = "original__"


@dataclass
class Workspace:
    """The tables under watch, how rules bind to them, and the moment that counts as now."""

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    bindings: Mapping[str, Binding] = field(default_factory=dict)
    as_of: dt.date | dt.datetime = field(default_factory=dt.datetime.now)
    weights: Mapping[str, str] = field(default_factory=lambda: WEIGHTS)  # of the dimensions in the health score

    def binding(self, name: str) -> Binding:
        return self.bindings.get(name, Binding())

    def bound(self, names: Sequence[str], rule_set: str | Iterable[str] = "executed") -> list[BoundRule]:
        return [
            rule for name in sorted(names)
            for rule in bind(name, self.tables[name].schema, self.binding(name), self.as_of, rule_set)
        ]

    def replacing(self, tables: Mapping[str, DataFrame]) -> Workspace:
        """The same workspace with other versions of some tables."""
        return replace(self, tables=ChainMap(dict(tables), self.tables))

    def key(self, name: str) -> list[str]:
        return key_columns(self.tables[name].schema, self.binding(name))


@dataclass
class Scan:
    """The counters of a scan; everything else is derived lazily."""

    workspace: Workspace
    rules: list[BoundRule]
    counts: DataFrame
    by: tuple[str, ...] = ()

    @cached_property
    def graded(self) -> DataFrame:
        """Every counter with its rule and severity, fired or not."""
        return issue_ops.grade(self.counts, issue_ops.rule_table(self.workspace.spark, self.rules))

    @property
    def issues(self) -> DataFrame:
        return issue_ops.fired(self.graded)

    @property
    def scores(self) -> DataFrame:
        return scoring.score_tables(self.graded, ("table_name", *self.by), self.workspace.weights)


# Report order and grades of rules that only the catalog knows.
OWN_SEQ, OWN_RISK, OWN_CONFIDENCE = 100, "MEDIUM", 90.0


def compile_catalog(ws: Workspace, catalog: DataFrame, predicates: DataFrame, names: Sequence[str]) -> tuple[set[str], list[BoundRule]]:
    """The stored rules that are to run: names of `rules.RULES`, and rules bound to a predicate of their own
    (`schemas.RULE_PREDICATES`). Inactive rules are left out here, so that nothing counts them; so are
    predicates that are no test of a row of their table. Catalog and predicates are configuration and read at once.
    """
    active = {row.rule_name: row for row in catalog.where("is_active").collect()}
    own = []
    for i, row in enumerate(sorted(predicates.collect(), key=lambda r: (r.rule_name, r.table_name))):
        if row.rule_name not in active or row.table_name not in names or not is_valid(ws.tables[row.table_name], row.predicate):
            continue
        stored, schema = active[row.rule_name], ws.tables[row.table_name].schema
        rule = Rule(OWN_SEQ + i, stored.rule_name, stored.rule_category, stored.severity_default, OWN_RISK, OWN_CONFIDENCE,
                    "{n} rows of {t}: " + stored.rule_description, "", "Review {c}", "", stored.rule_name)
        own.append(BoundRule(
            rule, row.table_name, schema.names.index(row.column_name), row.column_name, type_family(schema[row.column_name].dataType),
            lambda get, text=row.predicate: F.expr(f"(\n{text}\n)"), (row.column_name,)))
    return {rule.name for rule in RULES if rule.catalog in active}, own


def _keyed_counts(ws: Workspace, df: DataFrame, index: int, bound: BoundRule, by, phase: str) -> DataFrame:
    name, detail = bound.rule.name, bound.detail
    if name == "DUPLICATE_KEY":
        return keyed.count_duplicate_keys(df, index, detail, by, phase)
    if name == "ORPHAN_REFERENCE":
        return keyed.count_orphans(df, index, detail, ws.tables[detail.parent_table], by, phase)
    if by:
        raise ValueError(f"{name} is not counted per period")
    if name == "DUPLICATE_ROW":
        return keyed.count_duplicate_rows(df, index, phase)
    if name == "CASE_CONSISTENCY":
        return keyed.count_case_variants(df, index, bound.column, phase)
    if name == "FRESHNESS_CHECK":
        return keyed.count_stale(df, index, bound.column, *detail, phase)
    raise ValueError(f"no operator counts {name}")


def _same_lookup(fk: object, link: ParentDate) -> bool:
    return isinstance(fk, ForeignKey) and (fk.column, fk.parent_table, fk.parent_key) == (
        link.foreign_key, link.parent_table, link.parent_key)


def _table_branches(ws: Workspace, df: DataFrame, own: Sequence[tuple[int, BoundRule]], by, phase: str) -> list[DataFrame]:
    """The counters of the keyed rules of one table."""
    pending = {i: b for i, b in own if b.predicate is None}
    branches = []
    for i, b in list(pending.items()):
        if b.rule.name == "DATE_ORDERING":
            del pending[i]
            link = b.detail
            # Orphans of the same reference need the same lookup.
            orphans = next((j for j, o in pending.items() if _same_lookup(o.detail, link)), None)
            pending.pop(orphans, None)
            branches.append(
                keyed.count_before_parent(df, i, link, ws.tables[link.parent_table], by, phase, orphans))
    outliers = {i: b.column for i, b in pending.items() if b.rule.name == "OUTLIER_DETECTION"}
    if outliers and by:
        raise ValueError("OUTLIER_DETECTION is not counted per period")
    if outliers:
        branches.append(keyed.count_outliers(df, list(outliers), list(outliers.values()), phase))
    branches += [_keyed_counts(ws, df, i, b, by, phase) for i, b in pending.items() if i not in outliers]
    return branches


def _union(ws: Workspace, branches: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    if not branches:
        periods = "".join(f"{c} date, " for c in by)
        return literal_rows(ws.spark, periods + COUNTER_COLUMNS, [])
    return reduce(DataFrame.unionByName, branches)


def scan(
    ws: Workspace,
    names: Sequence[str],
    rule_set: str | Iterable[str] = "executed",
    period: Mapping[str, Column] | None = None,
    own: Sequence[BoundRule] = (),
) -> Scan:
    """Scan tables; with `period` (a date expression per table) every period is scanned by itself. `own` are
    bound rules beside those of the rule set."""
    rules = [*ws.bound(names, rule_set), *own]
    by = ("scan_date",) if period else ()
    branches = []
    for name in sorted(names):
        own = [(i, b) for i, b in enumerate(rules) if b.table == name]
        df = ws.tables[name]
        if period:
            df = df.withColumn("scan_date", period[name])
        row_rules = [(i, b) for i, b in own if b.predicate is not None]
        if row_rules:
            branches += count_row_rules(df, row_rules, by)
        branches += _table_branches(ws, df, own, by, CURRENT)
    return Scan(ws, rules, _union(ws, branches, by), by)


Approval = Callable[[Iterable[BoundRule]], list[BoundRule]]


def fixed_tables(ws: Workspace, names: Sequence[str], approved: Approval = safe_rules) -> dict[str, DataFrame]:
    """The tables with the approved fixes applied, by default all of low risk."""
    return {name: apply_fixes(ws.tables[name], approved(ws.bound([name]))) for name in names}


def scan_before_after(ws: Workspace, names: Sequence[str], approved: Approval = safe_rules) -> Scan:
    """Scan the tables as they are and as the approved fixes would leave them.

    The row rules of both versions are counted in the same pass over the table. The keyed rules
    read a few columns each; where the fixes leave those alone both phases are the same plan and
    Spark runs it once.
    """
    fixed = fixed_tables(ws, names, approved)
    after = ws.replacing(fixed)
    rules = ws.bound(names)
    branches = []
    for name in sorted(names):
        own = [(i, b) for i, b in enumerate(rules) if b.table == name]
        df = ws.tables[name]
        fixes = approved(b for _, b in own)
        touched = sorted({c for b in fixes for c in b.inputs})
        both = apply_fixes(df.withColumns({ORIGINAL + c: col(c) for c in touched}), fixes)
        phases = {BEFORE: lambda c, t=frozenset(touched): col(ORIGINAL + c if c in t else c), AFTER: col}
        row_rules = [(i, b) for i, b in own if b.predicate is not None]
        if row_rules:
            branches += count_row_rules(both, row_rules, phases=phases)
        branches += _table_branches(ws, df, own, (), BEFORE)
        branches += _table_branches(after, fixed[name], own, (), AFTER)
    return Scan(ws, rules, _union(ws, branches), ("phase",))
