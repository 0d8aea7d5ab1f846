"""Rows at risk, each counted once however many rules it breaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.binding import BoundRule, col
from plumbline.operators.rowscan import any_violation
from plumbline.operators.salting import flag_matching
from plumbline.operators.violations import early_pairs, orphan_keys


def distinct_rows_at_risk(
    df: DataFrame, table: str, bound: Sequence[BoundRule], tables: Mapping[str, DataFrame]
) -> DataFrame:
    """Rows that break a row rule, repeat a key, reference a missing parent or precede their parent.

    Rows are first folded to one per key, references and checked dates, with the number that break
    no row rule; the other rules then look at those only, leaving out rows that already count.
    """
    key = list(next((b.detail for b in bound if b.rule.name == "DUPLICATE_KEY"), ()))
    links = [b for b in bound if b.predicate is None and b.rule.name in ("ORPHAN_REFERENCE", "DATE_ORDERING")]
    bad_keys = [
        (orphan_keys if b.rule.name == "ORPHAN_REFERENCE" else early_pairs)(
            df, b.detail, tables[b.detail.parent_table])
        for b in links
    ]
    kept = list(dict.fromkeys([*key, *[c for keys in bad_keys for c in keys.columns if c in df.columns]]))
    folded = (
        df.withColumn("hit__", any_violation(bound).cast("long"))
        .groupBy(*[col(c) for c in kept])
        .agg(F.count(F.lit(1)).alias("n__"), F.sum("hit__").alias("hit__"))
        .withColumn("lost__", F.lit(False))
    )
    for keys in bad_keys:
        folded = flag_matching(folded, keys, kept, "bad__").withColumn(
            "lost__", F.col("lost__") | F.col("bad__")).drop("bad__")
    present = F.lit(bool(key))
    for name in key:
        present = present & col(name).isNotNull()
    clean = F.col("n__") - F.col("hit__")
    per_key = folded.groupBy(*[col(c) for c in key]).agg(
        F.sum("n__").alias("n"), F.sum("hit__").alias("hit"), F.sum(clean).alias("clean"),
        F.sum(F.when(F.col("lost__"), clean).otherwise(0)).alias("lost"),
    )
    at_risk = F.col("hit") + F.when(present & (F.col("n") > 1), F.col("clean")).otherwise(F.col("lost"))
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.coalesce(F.sum(at_risk), F.lit(0)).alias("rows_at_risk"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
    )
