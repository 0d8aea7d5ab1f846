"""Binding rules to a table's columns from its schema, column names and configuration."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T

from plumbline.functions import predicates as p
from plumbline.rules import BY_NAME, RULE_SETS, Rule

# Name keywords that bind the value and date rules.
NUMERIC_KEYWORDS = ("AMOUNT", "PRICE", "QUANTITY", "SCORE", "INCOME", "STOCK", "WEIGHT")
DATE_KEYWORDS = ("BIRTH", "REGISTRATION", "ORDER", "CREATED", "UPDATED")
EMAIL_KEYWORD = "EMAIL"
KEY_SUFFIX = "_ID"

Resolver = Callable[[str], Column]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def sql_escaped(text: str) -> str:
    """A text as it stands between single quotes in Spark SQL."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent_table: str
    parent_key: str
    parent_noun: str


@dataclass(frozen=True)
class ParentDate:
    """A date of this table that must not precede a date of its parent row."""

    column: str
    foreign_key: str
    parent_table: str
    parent_key: str
    parent_column: str


@dataclass(frozen=True)
class Binding:
    """What the schema alone cannot tell about a table."""

    noun: str = "rows"
    key: Sequence[str] | None = None  # default: the first column named *_ID
    foreign_keys: Sequence[ForeignKey] = ()
    allowed: Mapping[str, Sequence[str]] = field(default_factory=dict)
    date_pairs: Sequence[tuple[str, str]] = ()  # (start, end)
    amounts: Sequence[tuple[str, str, str]] = ()  # (total, quantity, price)
    prices: Sequence[tuple[str, str]] = ()  # (cost, price)
    parent_dates: Sequence[ParentDate] = ()
    # Used by the declared rules only.
    phones: Sequence[str] = ()
    cased: Sequence[str] = ()
    date_floors: Mapping[str, dt.date] = field(default_factory=dict)
    ranges: Mapping[str, tuple] = field(default_factory=dict)
    freshness: Mapping[str, int] = field(default_factory=dict)  # column -> maximal age in days
    outliers: Sequence[str] = ()


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def is_moment(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def type_family(data_type: T.DataType) -> str:
    """The type name the rule catalog uses."""
    if is_text(data_type):
        return "VARCHAR"
    if isinstance(data_type, T.NumericType):
        return "NUMBER"
    if isinstance(data_type, T.DateType):
        return "DATE"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    return "BOOLEAN" if isinstance(data_type, T.BooleanType) else "OTHER"


def key_columns(schema: T.StructType, binding: Binding) -> list[str]:
    if binding.key is not None:
        return list(binding.key)
    return [name for name in schema.names if name.upper().endswith(KEY_SUFFIX)][:1]


@dataclass(frozen=True)
class BoundRule:
    """A rule on a column. Row rules carry a predicate; the others are counted by their own operator."""

    rule: Rule
    table: str
    ordinal: int
    column: str
    family: str | None
    predicate: Callable[[Resolver], Column] | None = None
    inputs: tuple[str, ...] = ()  # columns the predicate reads
    detail: object = None  # what the rule's own operator needs
    texts: Mapping[str, str] = field(default_factory=dict)

    def text(self, template: str) -> str:
        """Fill in everything known before the data is read; {n}, {pct} and {groups} stay."""
        known = {"c": self.column, "t": self.table, **self.texts}
        template = self.texts.get("instead", template) if template == self.rule.remediation else template
        for name, value in known.items():
            template = template.replace("{" + name + "}", value)
        return template


def bind(
    table: str,
    schema: T.StructType,
    binding: Binding,
    as_of: dt.date | dt.datetime,
    rule_set: str | Iterable[str] = "executed",
) -> list[BoundRule]:
    """All rules that apply to a table, in the order their issues are reported."""
    wanted = RULE_SETS[rule_set] if isinstance(rule_set, str) else frozenset(rule_set)
    types = {f.name: f.dataType for f in schema.fields}
    position = {name: i for i, name in enumerate(schema.names)}
    text_columns = [c for c in schema.names if is_text(types[c])]
    bound: list[BoundRule] = []

    def add(rule_name: str, column: str, predicate=None, inputs=None, detail=None, **texts) -> None:
        if rule_name in wanted:
            bound.append(BoundRule(
                BY_NAME[rule_name], table, position.get(column, 0), column,
                type_family(types[column]) if column in types else None,
                predicate, tuple(inputs or (column,)), detail, {"noun": binding.noun, **texts},
            ))

    def add_simple(rule_name: str, column: str, test: Callable[..., Column], *args, **texts) -> None:
        add(rule_name, column, lambda get: test(get(column), *args), **texts)

    for c in schema.names:
        add_simple("NULL_CHECK", c, p.is_null)
    for c in text_columns:
        add_simple("BLANK_STRING", c, p.is_blank)
    key = key_columns(schema, binding)
    if key:
        add("DUPLICATE_KEY", ", ".join(key) if len(key) > 1 else key[0], detail=key,
            present=" AND ".join(f"{c} IS NOT NULL" for c in key))
    for c in schema.names:
        if EMAIL_KEYWORD in c.upper():
            add_simple("EMAIL_FORMAT", c, p.is_bad_email, pattern=sql_escaped(p.EMAIL_PATTERN))
    for c in schema.names:
        if isinstance(types[c], T.NumericType) and any(k in c.upper() for k in NUMERIC_KEYWORDS):
            add_simple("NEGATIVE_VALUE", c, p.is_negative)
    for c in schema.names:
        if is_moment(types[c]) and any(k in c.upper() for k in DATE_KEYWORDS):
            add_simple("FUTURE_DATE", c, p.is_after, as_of, as_of=str(as_of))
    for c, values in binding.allowed.items():
        if c in types:
            add_simple("INVALID_CATEGORY", c, p.is_not_allowed, tuple(values),
                       allowed=", ".join(f"'{sql_escaped(v)}'" for v in values))
    for c in text_columns:
        add_simple("WHITESPACE", c, p.is_padded)
    for fk in binding.foreign_keys:
        add("ORPHAN_REFERENCE", fk.column, detail=fk, parent=fk.parent_noun,
            parent_table=fk.parent_table, parent_key=fk.parent_key)
    for start, end in binding.date_pairs:
        add("DATE_ORDERING", end, lambda get, s=start, e=end: p.is_out_of_order(get(s), get(e)),
            (start, end), (start, end), start=start)
    for link in binding.parent_dates:
        # Dates of two tables can't be swapped by one statement, so the rows are listed.
        add("DATE_ORDERING", link.column, detail=link, instead=(
            f"SELECT * FROM {{t}} WHERE {{c}} < (SELECT max({link.parent_column}) FROM {link.parent_table} "
            f"WHERE {link.parent_key} = {link.foreign_key})"))
    for total, quantity, price in binding.amounts:
        add("AMOUNT_MISMATCH", total,
            lambda get, t=total, q=quantity, u=price: p.is_amount_off(get(t), get(q), get(u)),
            (total, quantity, price), (total, quantity, price), quantity=quantity, price=price)
    for cost, price in binding.prices:
        add("COST_EXCEEDS_PRICE", cost, lambda get, c=cost, u=price: p.is_loss(get(c), get(u)),
            (cost, price), price=price)

    if schema.names:
        add("DUPLICATE_ROW", "*", inputs=schema.names)
    for c in binding.phones:
        add_simple("PHONE_FORMAT", c, p.is_bad_phone)
    for c, floor in binding.date_floors.items():
        add_simple("DATE_RANGE", c, p.is_before, floor)
    for c, (low, high) in binding.ranges.items():
        add_simple("NUMERIC_RANGE", c, p.is_out_of_range, low, high)
    for c in binding.cased:
        add("CASE_CONSISTENCY", c)
    for c, days in binding.freshness.items():
        add("FRESHNESS_CHECK", c, detail=(days, as_of))
    for c in binding.outliers:
        add("OUTLIER_DETECTION", c)
    return bound
