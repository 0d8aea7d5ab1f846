"""Running sums over a whole table in order, without putting the table in one task.

The rows are dealt by ranges of the order and sorted; every task carries the running sums of its own
rows, and what its first group has in the ranges before it is added afterwards. That is one small row
for each range. Rows stay where they are, so a group that holds a third of them lies over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumbline.llm.common import settle

PART, LEADS = "part_", "leads_"


def _changes(values: pa.Array, last) -> tuple[np.ndarray, object]:
    """Where a group begins, and the group of the last row; a null equals a null."""
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = last is None or values[0].as_py() != last[0]
    return np.concatenate([[first], codes[1:] != codes[:-1]]), (values[-1].as_py(),)


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str], purpose: str, group: str | None = None) -> DataFrame:
    """The rows, written in ascending order (nulls first), with `<s>_before` for every long column s in
    `sums`: its sum over the earlier rows of the same group. `group` is the first column of the order.

    Rows that agree in the whole order are one task's, so the order should tell all rows apart.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(PART, T.LongType()), T.StructField(LEADS, T.BooleanType()),
                           *[T.StructField(f"{s}_before", T.LongType()) for s in sums]])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, runs = TaskContext.get().partitionId(), None, 0
        carry = np.zeros((len(sums), 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if group is None:
                begins = np.zeros(batch.num_rows, bool)
                begins[0], last = last is None, (None,)
            else:
                begins, last = _changes(batch.column(group), last)
            values = np.stack([batch.column(s).to_numpy() for s in sums])
            upto = np.cumsum(values, axis=1)
            before = upto - values
            start = np.maximum.accumulate(np.where(begins, np.arange(batch.num_rows), -1))
            before = np.where(start < 0, before + carry, before - before[:, start])
            run = runs + np.cumsum(begins)
            runs, carry = int(run[-1]), before[:, -1:] + values[:, -1:]
            added = [pa.array(np.full(batch.num_rows, part)), pa.array(run == 1), *map(pa.array, before)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    rows = settle(ranged.mapInArrow(carried, schema), purpose)
    # A row for each range and group in it; a group has at most one row for each range.
    by = [F.col(group)] if group else []
    pieces = rows.groupBy(PART, *by).agg(F.max(LEADS).alias(LEADS), *[F.sum(s).alias(s) for s in sums])
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumns({s: F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums}).where(LEADS)
    offsets = offsets.select(PART, LEADS, *[F.col(s).alias(f"{s}_offset") for s in sums])
    # One row for each range: as many as there are partitions.
    joined = rows.join(F.broadcast(offsets), [PART, LEADS], "left")
    totals = {f"{s}_before": F.col(f"{s}_before") + F.coalesce(f"{s}_offset", F.lit(0)) for s in sums}
    return joined.withColumns(totals).select(*df.columns, *totals)
