"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.sources.store import settle, shared_folder

__all__ = ["packed", "read", "settle", "shared_folder", "text_or_empty", "texts", "unpacked"]


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column can clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one, so that columns of any name can stand beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("packed")


def unpacked(docs: DataFrame) -> list[Column]:
    """The columns of a packed row."""
    return [F.col(f"packed.`{c}`").alias(c) for c in docs.columns]
