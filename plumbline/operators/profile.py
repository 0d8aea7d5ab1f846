"""Column profiles: one pass for counts and ranges, one for the values of all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.binding import col, is_text
from plumbline.functions.numbers import half_up, percent
from plumbline.operators.quantiles import exact_quantiles
from plumbline.sources.values import literal_rows


NUMERIC_PROFILE = (
    "table_name string, column_name string, min_value double, max_value double, mean_value double, "
    "median_value double, median_exact string, stddev_value double"
)
TEXT_PROFILE = "table_name string, column_name string, min_length int, max_length int, avg_length double"
TOP_VALUES = "table_name string, column_name string, value string, value_count bigint"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value. Reads one column and combines copies before the shuffle."""
    return df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# Values longer than this are told apart by their sha256.
WIDE = 64
# Where a value of each family stands in its group's key; the others are null.
FAMILIES = {"whole": "bigint", "real": "double", "text": "string"}


def _tagged(field: T.StructField) -> dict[str, Column]:
    """A value in its family: integers, dates and the like as integers, floats as doubles, the rest as text."""
    kind, value = field.dataType, col(field.name)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return {"whole": value.cast("bigint")}
    if isinstance(kind, T.DateType):
        return {"whole": F.unix_date(value).cast("bigint")}
    if isinstance(kind, T.TimestampType):
        return {"whole": F.unix_micros(value)}
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return {"real": value.cast("double")}
    if isinstance(kind, T.BinaryType):
        text = F.hex(value)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.when(value.isNotNull(), F.to_json(F.struct(value), {"ignoreNullFields": "false"}))
    else:
        text = value.cast("string")
    narrow = F.octet_length(text) <= WIDE
    return {"text": F.when(narrow, text).when(text.isNotNull(), F.concat(F.lit(" " * WIDE), F.sha2(text, 256)))}


def _distinct_counts(df: DataFrame) -> DataFrame:
    """(ordinal, total_rows, null_count, distinct_count) of every column, in one pass and one shuffle.

    Every value is tagged with its column's ordinal; equal ones are folded before the shuffle, so a column
    with few values, or mostly nulls, sends few rows. A null is a group of its own.
    """
    rows = []
    for i, field in enumerate(df.schema.fields):
        tagged = _tagged(field)
        parts = [tagged.get(family, F.lit(None)).cast(kind).alias(family) for family, kind in FAMILIES.items()]
        rows.append(F.struct(F.lit(i).alias("ordinal"), *parts))
    values = df.select(F.inline(F.array(*rows))).groupBy("ordinal", *FAMILIES).agg(F.count(F.lit(1)).alias("n"))
    filled = F.coalesce(*[F.col(family).cast("string") for family in FAMILIES]).isNotNull()
    counted = values.groupBy("ordinal").agg(
        F.sum("n").alias("total_rows"), F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("null_count"),
        F.count_if(filled).alias("distinct_count"))
    # An empty table has no values at all.
    columns = literal_rows(df.sparkSession, "ordinal int", [(i,) for i in range(len(df.columns))])
    return columns.join(counted, "ordinal", "left").na.fill(0)


def _sketched_counts(df: DataFrame) -> DataFrame:
    """The same in one aggregate without a shuffle of values; distinct counts are estimates."""
    stats = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(df.columns):
        stats += [F.count(col(c)).alias(f"filled_{i}"), F.approx_count_distinct(col(c)).alias(f"distinct_{i}")]
    return df.agg(*stats).select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"), F.col("total").alias("total_rows"),
            (F.col("total") - F.col(f"filled_{i}")).alias("null_count"), F.col(f"distinct_{i}").alias("distinct_count"),
        )
        for i in range(len(df.columns))
    ])))


def profile_columns(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """Type, nulls and distinct values of every column; `exact=False` estimates the distinct values."""
    merged = _distinct_counts(df) if exact else _sketched_counts(df)
    described = literal_rows(
        df.sparkSession,
        "ordinal int, ordinal_position int, table_name string, column_name string, data_type string, is_nullable string",
        [
            (i, i + 1, table, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO")
            for i, f in enumerate(df.schema.fields)
        ],
    )
    return merged.join(F.broadcast(described), "ordinal").select(
        "table_name", "column_name", "ordinal_position", "data_type", "is_nullable", "total_rows", "null_count",
        percent(F.col("null_count"), F.col("total_rows")).alias("null_pct"),
        "distinct_count",
        percent(F.col("distinct_count"), F.col("total_rows")).alias("uniqueness_pct"),
    )


def profile_numeric(df: DataFrame, table: str) -> DataFrame:
    """Least, greatest, mean, median and spread of the numeric columns; integers and decimals also have their
    median as text, with every digit to four places."""
    columns = numeric_columns(df)
    if not columns:
        return literal_rows(df.sparkSession, NUMERIC_PROFILE, [])
    wide = df.agg(*[
        F.struct(
            F.min(col(c)).cast("double").alias("min_value"), F.max(col(c)).cast("double").alias("max_value"),
            F.round(F.avg(col(c)).cast("double"), 2).alias("mean_value"),
            F.round(F.stddev(col(c)), 4).alias("stddev_value"),
        ).alias(c)
        for c in columns
    ])
    stats = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[
            F.col(f"`{c}`.{name}").alias(name) for name in ("min_value", "max_value", "mean_value", "stddev_value")
        ])
        for c in columns
    ])))
    medians = exact_quantiles(df, columns, (0.5,)).select(
        "column_name", F.round("value", 4).alias("median_value"), F.col("exact").alias("median_exact")
    )
    return stats.join(medians, "column_name", "left").select(
        F.lit(table).alias("table_name"), "column_name", "min_value", "max_value", "mean_value", "median_value",
        "median_exact", "stddev_value",
    )


def profile_text(df: DataFrame, table: str) -> DataFrame:
    """Shortest, longest and mean length of the text columns."""
    columns = text_columns(df)
    if not columns:
        return literal_rows(df.sparkSession, TEXT_PROFILE, [])
    wide = df.agg(*[
        F.struct(
            F.min(F.length(col(c))).alias("min_length"), F.max(F.length(col(c))).alias("max_length"),
            F.when(F.count(col(c)) > 0, half_up(F.sum(F.length(col(c))), F.count(col(c)), 1)).alias("avg_length"),
        ).alias(f"s{i}")
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
            *[F.col(f"s{i}.{name}").alias(name) for name in ("min_length", "max_length", "avg_length")],
        )
        for i, c in enumerate(columns)
    ])))


def top_values(df: DataFrame, table: str, n: int = 5) -> DataFrame:
    """The most frequent values of each text column; equally frequent ones in value order."""
    tops = [
        value_counts(df, c).orderBy(F.desc("n"), "value").limit(n).select(
            F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "value", F.col("n").alias("value_count")
        )
        for c in text_columns(df)
    ]
    return reduce(DataFrame.unionByName, tops) if tops else literal_rows(df.sparkSession, TOP_VALUES, [])


def profile_column(df: DataFrame, table: str, column: str) -> dict[str, DataFrame]:
    """Everything about one column: what is said depends on its type."""
    one = df.select(col(column))
    found = {"column": profile_columns(one, table)}
    if numeric_columns(one):
        found["numeric"] = profile_numeric(one, table)
    if text_columns(one):
        found["text"] = profile_text(one, table)
        found["top_values"] = top_values(one, table)
    return found
