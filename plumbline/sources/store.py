"""Where results go: Parquet tables and table snapshots below one shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from plumbline.schemas import STORED
from plumbline.sources.ledger import Ledger

SHARED_FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that all executors see.

    The cluster names its shared folder in `spark.checkpoint.dir`; only a local session without
    that setting gets a temporary one.
    """
    base = spark.conf.get(SHARED_FOLDER, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED_FOLDER} must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="plumbline-")
    return f"{base.rstrip('/')}/plumbline/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """The result of a DataFrame, written once: its size is known, and nothing computes it again."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Round:
    """The tables that one unit of work writes; readers see all of them when it is committed, or none."""

    def __init__(self, ledger: Ledger, label: str):
        self.ledger, self.label, self.tables = ledger, label, {}

    def put(self, name: str, rows: DataFrame, by: str | None = None) -> DataFrame:
        """Writes rows of a table, and gives them back as they were written."""
        folder = self.ledger.write(name, rows, by)
        self.tables.setdefault(name, []).append(folder)
        return rows.sparkSession.read.schema(rows.schema).parquet(folder)

    def commit(self) -> None:
        self.ledger.commit(self.label, self.tables)


class Store:
    """The engine's tables below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, self.path("rounds"))

    def round(self, label: str) -> Round:
        """A unit of work; committing a label again replaces what it wrote before."""
        return Round(self.ledger, label)

    def read(self, name: str) -> DataFrame:
        """The committed rows of a stored table, or a table that was written whole."""
        if name in STORED:
            return self.ledger.read(name, StructType.fromDDL(STORED[name]))
        return self.spark.read.parquet(self.path(name))

    def read_fixed(self, table: str) -> DataFrame:
        """A table as the last committed round left it."""
        return self.spark.read.parquet(self.ledger.folders(f"fixed_{table}")[-1])

    def materialise(self, name: str, df: DataFrame) -> DataFrame:
        """Write once and read back, so that later steps neither recompute nor depend on the first run."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def write_snapshot(self, table: str, version: str, df: DataFrame) -> DataFrame:
        """A new version of a table; earlier versions stay as they are."""
        return self.materialise(f"snapshots/{table}/{version}", df)

    def read_snapshot(self, table: str, version: str) -> DataFrame:
        """Any kept version; reading an earlier one undoes a fix."""
        return self.read(f"snapshots/{table}/{version}")
