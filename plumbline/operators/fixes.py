"""Fixes as column transforms: a fixed table is a new DataFrame, the old one stays readable."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.binding import BoundRule, col
from plumbline.operators.keyed import all_present, duplicate_key_groups
from plumbline.operators.salting import settled
from plumbline.schemas import FIX_IMAGES
from plumbline.sources.values import literal_rows

# The rules whose fix is a transform of the offending row.
FIXABLE = (
    "BLANK_STRING", "EMAIL_FORMAT", "NEGATIVE_VALUE", "FUTURE_DATE", "INVALID_CATEGORY",
    "WHITESPACE", "DATE_ORDERING", "AMOUNT_MISMATCH",
)


def can_fix(bound: BoundRule) -> bool:
    return bound.rule.name in FIXABLE and bound.predicate is not None


def safe_rules(bound: Iterable[BoundRule]) -> list[BoundRule]:
    return [b for b in bound if can_fix(b) and b.rule.risk == "LOW"]


def _new_values(bound: BoundRule, types: dict) -> dict[str, Column]:
    """What a fix sets on an offending row."""
    if bound.rule.name == "WHITESPACE":
        new = {bound.column: F.trim(col(bound.column))}
    elif bound.rule.name == "DATE_ORDERING":
        start, end = bound.inputs
        new = {start: col(end).cast(types[start]), end: col(start).cast(types[end])}
    elif bound.rule.name == "AMOUNT_MISMATCH":
        total, quantity, price = bound.inputs
        new = {total: (col(quantity) * col(price)).cast(types[total])}
    else:
        new = {bound.column: F.lit(None).cast(types[bound.column])}
    return new


def _fix_columns(bound: BoundRule, types: dict) -> dict[str, Column]:
    bad = bound.predicate(col)
    return {name: F.when(bad, value).otherwise(col(name)) for name, value in _new_values(bound, types).items()}


def _in_order(rules: Iterable[BoundRule]) -> list[BoundRule]:
    return sorted(rules, key=lambda b: (b.rule.seq, b.ordinal))


def apply_fixes(df: DataFrame, rules: Sequence[BoundRule]) -> DataFrame:
    """Apply the given bound rules' fixes in report order; each sees the result of the ones before.

    A fix whose rule finds nothing changes nothing, so no scan has to run first. One fix sets all
    its columns at once from the old values (a swap needs both); fixes that do not touch each
    other's columns share a projection.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    pending: dict[str, Column] = {}
    for bound in _in_order(rules):
        if pending.keys() & set(bound.inputs):
            df, pending = df.withColumns(pending), {}
        pending |= _fix_columns(bound, types)
    return df.withColumns(pending) if pending else df


def key_text(key: Sequence[str]) -> Column:
    """A row's key as text; rows without a key column have none."""
    return F.concat_ws(", ", *[col(c).cast("string") for c in key])


def fix_images(df: DataFrame, table: str, key: Sequence[str], rules: Sequence[BoundRule]) -> DataFrame:
    """What each fix changes, row by row (`schemas.FIX_IMAGES`): the key, the rule and its column, and for
    every column that gets another value the old and the new one, as text.

    The fixes are applied in report order as in `apply_fixes`, in one pass; a fix sees what the ones before left.
    """
    if not rules:
        return literal_rows(df.sparkSession, FIX_IMAGES, [])
    types, images, key_columns = {f.name: f.dataType for f in df.schema.fields}, [], list(key)
    df = df.withColumn("key__", key_text(key_columns))
    for i, bound in enumerate(_in_order(rules)):
        bad, new = F.coalesce(bound.predicate(col), F.lit(False)), _new_values(bound, types)
        changes = F.array(*[F.struct(
            F.lit(name).alias("column_name"), col(name).cast("string").alias("old_value"),
            value.cast(types[name]).cast("string").alias("new_value")) for name, value in new.items()])
        changes = F.filter(changes, lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
        image = F.struct(F.lit(bound.rule.name).alias("rule_name"), F.lit(bound.column).alias("column_name"), changes.alias("changes"))
        images.append(f"image__{i}")
        df = df.withColumns({images[-1]: F.when(bad, image), **_fix_columns(bound, types)})
    made = F.filter(F.array(*[col(i) for i in images]), lambda image: image.isNotNull() & (F.size(image["changes"]) > 0))
    return df.select(F.lit(table).alias("table_name"), F.col("key__").alias("key_value"), F.inline(made))


def undo(fixed: DataFrame, images: DataFrame, key: Sequence[str], rule_name: str, column: str) -> DataFrame:
    """A fixed table without one of its fixes: the old values come back where the fix's new ones still stand.

    Keys that stand for several rows don't tell which of them was changed and are left alone.
    """
    own = images.where((F.col("rule_name") == rule_name) & (F.col("column_name") == column))
    # Keys of one image; then those of one row.
    single = own.groupBy("key_value").agg(F.count(F.lit(1)).alias("n"), F.first("changes").alias("changes__")).where("n = 1").drop("n")
    rows = fixed.withColumn("key__", key_text(list(key)))
    once = rows.join(single, F.col("key__") == F.col("key_value"), "left_semi").groupBy("key__").agg(
        F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    back = single.join(once, F.col("key_value") == F.col("key__"), "left_semi")
    joined = rows.join(back, F.col("key__") == F.col("key_value"), "left")

    def restored(name: str, kind: T.DataType) -> Column:
        change = F.get(F.filter("changes__", lambda c: c["column_name"] == name), F.lit(0))
        stands = change.isNotNull() & col(name).cast("string").eqNullSafe(change["new_value"])
        return F.when(F.coalesce(stands, F.lit(False)), change["old_value"].cast(kind)).otherwise(col(name)).alias(name)

    return joined.select(*[restored(f.name, f.dataType) for f in fixed.schema.fields])


def failure(df: DataFrame, bound: BoundRule) -> str | None:
    """Why a fix can't be applied, if it can't; runs it over its columns."""
    try:
        apply_fixes(df, [bound]).select(*[col(c) for c in bound.inputs]).write.format("noop").mode("overwrite").save()
    except PySparkException as error:
        return error.getCondition() or str(error).splitlines()[0]
    return None


def choose(bound: Iterable[BoundRule], rule_name: str, columns: Sequence[str] = ()) -> list[BoundRule]:
    """The bound rules an operator approved by name and, optionally, column."""
    return [
        b for b in bound
        if b.rule.name == rule_name and can_fix(b) and (not columns or b.column in columns)
    ]


def deduplicate(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per non-null key: the first by `order`, then by all other columns. Null keys are kept.

    Keys alone are shuffled to find the repeated ones. If those are few, all other rows stay where
    they are. The first row is a minimum over whole rows, which combines before the shuffle: a key
    with very many copies is no hot spot, as it would be for a ranking window.
    """
    rest = [c for c in df.columns if c not in key]
    ranked = [*order, *[c for c in rest if c not in order]]
    if not ranked:
        present = all_present(key)
        return df.where(present).distinct().unionByName(df.where(~present))
    repeated, few = settled(duplicate_key_groups(df, key).select(*[col(c) for c in key]))
    if few:
        copies = df.join(F.broadcast(repeated), list(key), "left_semi")
        others = df.join(F.broadcast(repeated), list(key), "left_anti")
    else:
        copies, others = df.where(all_present(key)), df.where(~all_present(key))
    first = (
        copies.groupBy(*[col(c) for c in key])
        .agg(F.min(F.struct(*[col(c) for c in ranked])).alias("first_row"))
        .select(*[col(c) for c in key], *[F.col(f"first_row.`{c}`") for c in ranked])
    )
    return first.select(*[col(c) for c in df.columns]).unionByName(others.select(*[col(c) for c in df.columns]))
