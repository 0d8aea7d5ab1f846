"""Finding the rows of a large table that match a set of distinct keys of unknown size.

The keys, each with its number of rows (`n_rows`), are written to the shared folder first. Then
their size in bytes is known: small sets are broadcast and the table is not shuffled; others are
joined by a shuffle. In that join the rows of a hot key are spread over salts by a hash of their
other columns, and the hot key is repeated once per salt. A key gets as many salts as its measured
number of rows asks for. The hash depends on the row alone, so a task that is run again sends every
row to the same place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.binding import col, is_text
from plumbline.sources.store import settle

BROADCAST_BYTES = 10 << 20  # of keys in memory, by their measured sizes
FIXED_BYTES = 16  # of a value beside its text
SALT, SALTS, HASH = "salt__", "salts__", "hash__"
# A key is hot with more rows than one task should get: HOT_ROWS, or one in HOT_SHARE of all matching
# rows where that is more. So hot keys and their salts number at most 2 * HOT_SHARE, whatever the table.
HOT_ROWS = 1_000_000
HOT_SHARE = 10_000


def settled(keys: DataFrame) -> tuple[DataFrame, bool]:
    """The written keys, and whether their values are few and narrow enough to broadcast."""
    written = settle(keys, "keys")
    size = F.lit(0)
    for field in written.schema.fields:
        name = col(field.name)
        text = name if is_text(field.dataType) else F.lit(None) if _is_fixed(field) else F.to_json(F.struct(name))
        size = size + FIXED_BYTES + F.coalesce(F.octet_length(text.cast("string")), F.lit(0))
    return written, (written.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _is_fixed(field) -> bool:
    """Numbers, dates and the like; arrays, structs and binaries are as long as their text."""
    return field.dataType.typeName() not in ("array", "struct", "map", "binary", "variant")


def _rows_per_task(keys: DataFrame) -> int:
    total = keys.agg(F.sum("n_rows")).first()[0] or 0
    return max(HOT_ROWS, total // HOT_SHARE)


def _salt(spread_by: Sequence[str], salts: Column) -> Column:
    return F.pmod(F.xxhash64(*[col(c) for c in spread_by]), salts).cast("int")


def _join(df: DataFrame, keys: DataFrame, spread_by: Sequence[str], how: str) -> DataFrame:
    written, few = settled(keys)
    on = [c for c in keys.columns if c in df.columns]
    if few:
        return df.join(F.broadcast(written.drop("n_rows")), on, how)
    limit = _rows_per_task(written)
    # Hot keys by their hash: a few bytes each, however wide the keys; both sides ask the same list,
    # so a key that shares a hot one's hash is repeated like it.
    key_hash = F.xxhash64(*[col(c) for c in on])
    hot = F.broadcast(written.where(F.col("n_rows") > limit).groupBy(key_hash.alias(HASH)).agg(
        F.ceil(F.max("n_rows") / limit).cast("int").alias(SALTS)))
    salted_rows = df.withColumn(HASH, key_hash).join(hot, HASH, "left").withColumn(
        SALT, F.when(F.col(SALTS).isNotNull(), _salt(spread_by, F.col(SALTS))).otherwise(0)).drop(HASH, SALTS)
    each = F.sequence(F.lit(0), F.coalesce(F.col(SALTS), F.lit(1)) - 1)
    salted_keys = written.withColumn(HASH, key_hash).join(hot, HASH, "left").withColumn(
        SALT, F.explode(each)).drop("n_rows", HASH, SALTS)
    # The keys were measured; the planner would judge them by their compressed files.
    return salted_rows.join(salted_keys.hint("merge"), [*on, SALT], how).drop(SALT)


def keep_matching(df: DataFrame, keys: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Rows whose values in the key columns are one of the keys."""
    return _join(df, keys, spread_by, "left_semi").select(*[col(c) for c in df.columns])


def flag_matching(df: DataFrame, keys: DataFrame, spread_by: Sequence[str], flag: str) -> DataFrame:
    """All rows, with `flag` true where their values are one of the keys."""
    joined = _join(df, keys.withColumn(flag, F.lit(True)), spread_by, "left")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
