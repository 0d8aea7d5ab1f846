"""Rules that need rows brought together: copies, orphans, parent dates, spelling, freshness, outliers.

All of them aggregate before they shuffle: what crosses the network is one partial row per key
and task, so a key that holds a third of the table costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.binding import ForeignKey, ParentDate, col
from plumbline.functions.predicates import moment
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.rowscan import CURRENT, counter_rows
from plumbline.operators.salting import settled


def all_present(columns: Sequence[str]) -> Column:
    present = col(columns[0]).isNotNull()
    for name in columns[1:]:
        present = present & col(name).isNotNull()
    return present


def _single_counter(df: DataFrame, by, index, phase, affected, total, groups=None) -> DataFrame:
    wide = df.groupBy(*by).agg(
        F.sum(affected).alias("a"), F.sum(total).alias("t"),
        F.sum(groups if groups is not None else F.lit(0)).alias("g"),
    )
    return counter_rows(wide, by, [(index, phase, "a", "g", "t")])


def key_counts(df: DataFrame, key: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Rows per key (nulls included), as column `n_rows`. Rows that stand for several have their number in
    `weight`, so counts of parts of a table add up to those of the whole."""
    n_rows = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*by, *[col(c) for c in key]).agg(n_rows.alias("n_rows"))


def count_duplicate_keys(df, index: int, key: Sequence[str], by=(), phase: str = CURRENT, weight: str | None = None) -> DataFrame:
    """Rows whose non-null key occurs more than once, first copies included, and the number of such keys."""
    repeated = (F.col("n_rows") > 1) & all_present(key)
    return _single_counter(
        key_counts(df, key, by, weight), by, index, phase,
        affected=F.when(repeated, F.col("n_rows")), total=F.col("n_rows"), groups=F.when(repeated, 1),
    )


def duplicate_key_groups(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The repeated keys with their number of rows."""
    present = df.where(all_present(key))
    return key_counts(present, key).where("n_rows > 1")


def parent_keys(parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    return parent.where(col(parent_key).isNotNull()).select(col(parent_key).alias(name)).distinct()


def count_orphans(
    df, index: int, fk: ForeignKey, parent: DataFrame, by=(), phase: str = CURRENT, weight: str | None = None
) -> DataFrame:
    """Rows whose non-null reference names no parent row; each distinct reference is looked up once."""
    references = key_counts(df, [fk.column], by, weight).withColumnRenamed(fk.column, "ref")
    known = parent_keys(parent, fk.parent_key, "ref").withColumn("known", F.lit(True))
    looked_up = references.join(known, "ref", "left")
    orphan = F.col("ref").isNotNull() & F.col("known").isNull()
    return _single_counter(
        looked_up, by, index, phase, affected=F.when(orphan, F.col("n_rows")), total=F.col("n_rows")
    )


def parent_dates(parent: DataFrame, link: ParentDate, name: str) -> DataFrame:
    """The parent's date per key (the latest if the key repeats)."""
    return (
        parent.where(col(link.parent_key).isNotNull())
        .groupBy(col(link.parent_key).alias(name))
        .agg(F.max(col(link.parent_column)).alias("parent_date"))
    )


def count_before_parent(
    df, index: int, link: ParentDate, parent: DataFrame, by=(), phase: str = CURRENT, orphan_index: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Rows dated before their parent row; equal dates of one reference are compared once.

    With `orphan_index` the rows without a parent are counted in the same lookup.
    """
    dated = key_counts(df, [link.foreign_key, link.column], by, weight)
    known = parent_dates(parent, link, link.foreign_key).withColumn("known", F.lit(True))
    joined = dated.join(known, link.foreign_key, "left")
    early = col(link.column) < F.col("parent_date")
    orphan = col(link.foreign_key).isNotNull() & F.col("known").isNull()
    wide = joined.groupBy(*by).agg(
        F.sum(F.when(early, F.col("n_rows"))).alias("early"), F.sum(F.when(orphan, F.col("n_rows"))).alias("orphans"),
        F.sum("n_rows").alias("t"),
    )
    counters = [(index, phase, "early", None, "t")]
    if orphan_index is not None:
        counters.append((orphan_index, phase, "orphans", None, "t"))
    return counter_rows(wide, by, counters)


def _row_hashes(df: DataFrame) -> DataFrame:
    """Rows with a hash of their columns; maps have none and are left to the comparison of columns."""
    hashed = [col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.withColumn("row_hash", F.xxhash64(*hashed) if hashed else F.lit(0).cast("long"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """The repeated rows, once each, with their number of copies (`n_rows`); nulls equal nulls.

    Eight-byte hashes are shuffled first. If few of them repeat, only the rows with those hashes
    move, and equality is decided on the columns themselves; if many do, all rows are grouped,
    combining copies before the shuffle.
    """
    hashed = _row_hashes(df)
    repeated, few = settled(key_counts(hashed, ["row_hash"]).where("n_rows > 1").select("row_hash"))
    candidates = hashed.join(F.broadcast(repeated), "row_hash", "left_semi") if few else hashed
    return key_counts(candidates, df.columns).where("n_rows > 1")


def count_duplicate_rows(df, index: int, phase: str = CURRENT) -> DataFrame:
    total = df.agg(F.lit(0).alias("a"), F.count(F.lit(1)).alias("t"), F.lit(0).alias("g"))
    copies = duplicate_rows(df).agg(
        F.sum("n_rows").alias("a"), F.lit(0).alias("t"), F.count(F.lit(1)).alias("g")
    )
    return _single_counter(
        total.unionByName(copies), (), index, phase, F.col("a"), F.col("t"), F.col("g")
    )


def count_case_variants(df, index: int, column: str, phase: str = CURRENT) -> DataFrame:
    """Values not spelled like the most frequent spelling of the same word."""
    spellings = key_counts(df, [column]).withColumnRenamed("n_rows", "n")
    words = spellings.groupBy(F.lower(F.trim(col(column))).alias("word")).agg(
        F.sum("n").alias("n_word"), F.max("n").alias("n_main")
    )
    variants = F.when(F.col("word").isNotNull(), F.col("n_word") - F.col("n_main"))
    return _single_counter(words, (), index, phase, affected=variants, total=F.col("n_word"))


def count_stale(df, index: int, column: str, max_age_days: int, as_of, phase: str = CURRENT) -> DataFrame:
    """All rows, if the newest value of the column is too old."""
    newest = df.agg(F.max(col(column)).alias("newest"), F.count(F.lit(1)).alias("n"))
    stale = F.datediff(moment(as_of), F.col("newest")) > max_age_days
    return _single_counter(newest, (), index, phase, affected=F.when(stale, F.col("n")), total=F.col("n"))


def outlier_fences(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, low, high): one and a half quartile distances outside the quartiles."""
    quartiles = exact_quantiles(df, columns, (0.25, 0.75)).groupBy("column_name").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return quartiles.select(
        "column_name", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")
    )


def count_outliers(df, indices: Sequence[int], columns: Sequence[str], phase: str = CURRENT) -> DataFrame:
    """Values outside the fences of their column; one counter per column, all in one pass."""
    values = ", ".join(
        f"struct({index} AS rule_index, '{c}' AS column_name, CAST(`{c}` AS DOUBLE) AS v)"
        for index, c in zip(indices, columns)
    )
    judged = df.selectExpr(f"inline(array({values}))").join(
        F.broadcast(outlier_fences(df, columns)), "column_name", "left")  # a row per column
    return judged.groupBy("rule_index").agg(
        F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("affected_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    ).select(
        F.lit(phase).alias("phase"), "rule_index", "affected_rows", F.lit(0).cast("long").alias("duplicate_groups"),
        "total_rows",
    )
