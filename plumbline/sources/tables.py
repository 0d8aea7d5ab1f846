"""Reading tables and the simplest questions about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.binding import col


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def stored_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The Parquet tables of a folder, by name, as its file system lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [name.removesuffix(".parquet") for name in (status.getPath().getName() for status in found) if name.endswith(".parquet")]
    return {name: load(spark, directory, name) for name in sorted(names)}


def catalog_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The stored tables of a database, by name."""
    listed = spark.catalog.listTables(database)
    return {t.name: spark.table(f"`{database}`.`{t.name}`") for t in listed if not t.isTemporary and t.tableType != "VIEW"}


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table name, rows and columns, by name. Parquet answers this from file footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
        )
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")


def sample_rows(df: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows by key, ties broken by all other columns."""
    rest = [c for c in df.columns if c not in key]
    return df.orderBy(*[col(c).asc_nulls_last() for c in (*key, *rest)]).limit(n)
