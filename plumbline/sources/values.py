"""Small literal relations (the counterpart of an inline VALUES list)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def literal_rows(spark: SparkSession, schema: StructType | str, rows: Sequence[tuple]) -> DataFrame:
    """Rows as a local relation: its size is known to the planner, so joins broadcast it by themselves."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(list(values), field.type) for values, field in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema)
