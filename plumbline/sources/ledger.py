"""Which written folders count: all that one unit of work wrote becomes visible at once, or nothing does.

A unit of work (a micro-batch, a round of scans and fixes) writes its tables into fresh folders and then
commits them under its key: one small file that names them, put in place by a rename. What was written
but not committed is never read. Committing a key again replaces what it named, so work that is done
twice counts once.

A commit may stand for all keys up to its own (`upto`); it names the folders that they are folded into, and
the ones before it are not read any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

COMMITS = "commits"
UNIT = "unit__"  # names a folder among those of its table


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, table: str, df: DataFrame, by: str | None = None) -> str:
        """Writes rows into a folder that nobody reads until it is committed."""
        folder = f"{self.root}/{table}/{UNIT}=u{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(folder)
        return folder

    def commit(self, key: str, tables: Mapping[str, list[str]], upto: bool = False) -> None:
        """Makes the folders of a unit of work visible, in place of those it may have committed before."""
        text = json.dumps({"key": key, "tables": tables, "upto": upto})
        draft = self._path(f"{self.root}/{COMMITS}/.{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        choice = self.spark.sparkContext._gateway.new_array(options, 1)
        choice[0] = options.OVERWRITE
        context.rename(draft, self._path(f"{self.root}/{COMMITS}/{key}.json"), choice)

    def committed(self, before: str | None = None) -> list[dict]:
        """The commits in the order of their keys, from the last that stands for all before it; with
        `before`, as they were before that key."""
        folder = self._path(f"{self.root}/{COMMITS}")
        if not self._files.exists(folder):
            return []
        names = sorted(status.getPath().getName() for status in self._files.listStatus(folder))
        found: list[dict] = []
        for name in reversed(names):  # only those since the last that stands for all before it are opened
            if name.startswith(".") or (before is not None and name.removesuffix(".json") >= before):
                continue
            stream = self._files.open(self._path(f"{self.root}/{COMMITS}/{name}"))
            try:
                found.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
            if found[-1]["upto"]:
                break
        return found[::-1]

    def folders(self, table: str, before: str | None = None) -> list[str]:
        return [folder for entry in self.committed(before) for folder in entry["tables"].get(table, ())]

    def read(self, table: str, schema: StructType, before: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
        """The rows of a table that are committed, and those of `more` folders; empty if there are none."""
        folders = [*self.folders(table, before), *more]
        if not folders:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*folders)
        return found.select(*[f"`{name}`" for name in schema.names])
