"""Watching arriving data with Structured Streaming.

Every run ends when the data that was there at its start is used up (`availableNow`); started
again with the same folder it goes on with what has arrived since. The `run_...` functions that keep
tables of their own commit them batch by batch (`sources.ledger`): a batch counts once, however often it
is run, and readers see whole batches only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from plumbline.binding import BoundRule, ForeignKey, col
from plumbline.operators import keyed, records
from plumbline.operators.rowscan import count_row_rules
from plumbline.operators.violations import orphan_rows
from plumbline.plans.cycle import DATABASE, SCHEMA
from plumbline.plans.scan import Scan, Workspace
from plumbline.sources.ledger import Ledger

EVENT_TIME = "event_time"
WATERMARK = "1 hour"
# What one micro-batch takes at most, but for a single larger file.
BATCH_BYTES = 8 << 30


def read_stream(
    spark: SparkSession, directory: str, name: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A table as a stream of its files, whether it is one Parquet file or a folder of them. A batch takes
    at most `files_per_batch` files or, without, BATCH_BYTES."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader.option("maxBytesPerTrigger", BATCH_BYTES)
    if status.isDirectory():
        return reader.parquet(f"{directory}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def event_time(column: str) -> Column:
    """A zone-less timestamp taken as UTC, whatever the session's zone (watermarks need an instant)."""
    return F.expr(f"TIMESTAMP'1970-01-01 00:00:00Z' + (`{column}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def without_zone(instant: str) -> Column:
    """The UTC wall clock of an instant."""
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + ({instant} - TIMESTAMP'1970-01-01 00:00:00Z')")


def with_event_time(stream: DataFrame, column: str, watermark: str = WATERMARK) -> DataFrame:
    return stream.withColumn(EVENT_TIME, event_time(column)).withWatermark(EVENT_TIME, watermark)


def window_counts(stream: DataFrame, rules: Sequence[BoundRule], window: str = "1 day") -> DataFrame:
    """Violations of the row rules per tumbling window; takes a stream with event time."""
    numbered = [(i, b) for i, b in enumerate(rules) if b.predicate is not None]
    windowed = stream.withColumn("window", F.window(EVENT_TIME, window))
    branches = count_row_rules(windowed, numbered, by=("window",))
    if len(branches) > 1:
        raise ValueError("too many rules for one streaming aggregation")
    return branches[0].withColumn("window_start", without_zone("window.start")).drop("window", "phase")


def first_occurrences(stream: DataFrame, key: Sequence[str], within_watermark: bool = False) -> DataFrame:
    """Drops rows whose key was seen before, in whatever order rows arrive.

    The keys seen are kept in the state store, off the heap and in the checkpoint. A stream with a
    watermark loses rows that arrive behind it, so only `within_watermark` takes one: it keeps the
    keys of that time and no others, and is for streams that are known to be no later.
    """
    if within_watermark:
        return stream.dropDuplicatesWithinWatermark(list(key))
    return stream.dropDuplicates(list(key))


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Append the stream to a Parquet table, each row exactly once, and read that table."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_to_latest(aggregate: DataFrame, folder: str) -> DataFrame:
    """Keep the current result of an aggregation; each batch replaces the table of the last."""
    spark = aggregate.sparkSession

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table")

    query = (
        aggregate.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(aggregate.schema).parquet(f"{folder}/table")


def landed(df: DataFrame, folder: str, name: str, files: int = 3) -> str:
    """A table as files that arrive one after another; rows beside each other go to different files."""
    dealt = df.withColumn("file_", F.monotonically_increasing_id() % files)
    dealt.repartitionByRange(files, "file_").drop("file_").write.parquet(f"{folder}/{name}.parquet")
    return folder


def _epoch(number: int) -> str:
    return f"{number:012d}"


# Epochs after which what they wrote is folded into one folder for each table.
FOLD_EVERY = 50
Handler = Callable[[DataFrame, int], dict[str, list[str]]]


def _run_epochs(stream: DataFrame, ledger: Ledger, folder: str, handle: Handler,
                fold: Callable[[int, dict], dict[str, list[str]]] | None = None) -> None:
    """Hands every micro-batch to a batch operator and commits what that wrote under the batch's number.

    A batch that is run again sees what was committed before it, and its commit replaces the first one.
    """

    def keep(batch: DataFrame, number: int) -> None:
        tables = handle(batch, number)
        folded = fold is not None and number % FOLD_EVERY == FOLD_EVERY - 1
        ledger.commit(_epoch(number), fold(number, tables) if folded else tables, upto=folded)

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_window_counts(
    stream: DataFrame, rules: Sequence[BoundRule], folder: str, window: str = "1 day", delay: str = WATERMARK
) -> DataFrame:
    """Violations of the row rules per tumbling window, of any number of rules; takes a stream with event time.

    Every batch adds its own counts, so the stream itself has no state, late rows count where they belong,
    and a batch that is run twice counts once. A window `is_final` when a window that begins `delay`
    after its end has been seen; the table has a row per window and rule that ever had a row.
    """
    ledger = Ledger(stream.sparkSession, f"{folder}/table")
    numbered = [(i, b) for i, b in enumerate(rules) if b.predicate is not None]

    def added(parts: DataFrame) -> DataFrame:
        return parts.groupBy("window_start", "window_end", "rule_index").agg(
            *[F.sum(c).alias(c) for c in ("affected_rows", "duplicate_groups", "total_rows")])

    def counts(batch: DataFrame) -> DataFrame:
        windowed = batch.withColumn("window", F.window(EVENT_TIME, window))
        parts = reduce(DataFrame.unionByName, count_row_rules(windowed, numbered, by=("window",)))
        return added(parts.select(without_zone("window.start").alias("window_start"), without_zone("window.end").alias("window_end"),
                                  "rule_index", "affected_rows", "duplicate_groups", "total_rows"))

    schema = counts(_empty(stream)).schema

    def handle(batch: DataFrame, number: int) -> dict[str, list[str]]:
        return {"counts": [ledger.write("counts", counts(batch))]}

    def fold(number: int, tables: dict) -> dict[str, list[str]]:
        whole = ledger.read("counts", schema, _epoch(number), tuple(tables["counts"]))
        return {"counts": [ledger.write("counts", added(whole))]}

    _run_epochs(stream, ledger, folder, handle, fold)
    kept = added(ledger.read("counts", schema))
    # One row: the newest window.
    newest = kept.agg(F.max("window_start").alias("newest")).withColumn("rule_", F.explode(F.lit([i for i, _ in numbered])))
    final = F.expr(f"window_end + INTERVAL {delay} <= newest")
    return kept.join(F.broadcast(newest), F.col("rule_index") == F.col("rule_")).withColumn("is_final", final).drop("newest", "rule_", "window_end")


def _empty(stream: DataFrame) -> DataFrame:
    return stream.sparkSession.createDataFrame([], stream.schema)


# Parts of the index of seen keys, a file each; a batch reads those that its own keys fall into.
KEY_PARTS = 32


def run_first_occurrences(stream: DataFrame, key: Sequence[str], folder: str, parts: int = KEY_PARTS) -> DataFrame:
    """The first row of every key, in whatever order and however late rows arrive, each exactly once.

    The keys seen are a table beside the stream, partitioned by a hash of the key, so the stream has no
    state that grows. A batch meets the parts of it that its keys fall into; of several rows of a key in one
    batch the least by the other columns stays. Null keys are keys like any other.
    """
    ledger = Ledger(stream.sparkSession, f"{folder}/table")
    columns, rest = stream.columns, [c for c in stream.columns if c not in key]
    part = F.pmod(F.xxhash64(*[col(c) for c in key]), F.lit(parts)).cast("int").alias("part")
    key_schema = _empty(stream).select(*[col(c) for c in key], part).schema

    def handle(batch: DataFrame, number: int) -> dict[str, list[str]]:
        first = batch.groupBy(*[col(c) for c in key]).agg(F.min(F.struct(F.lit(0), *[col(c) for c in rest])).alias("row"))
        own = first.select(*[col(c) for c in key], *[F.col(f"row.`{c}`").alias(c) for c in rest])
        arrived = stream.sparkSession.read.schema(own.schema).parquet(ledger.write("arrived", own))
        touched = [r[0] for r in arrived.select(part).distinct().collect()]  # at most `parts` numbers
        seen = ledger.read("keys", key_schema, _epoch(number)).where(F.col("part").isin(touched)).drop("part")
        seen = seen.select(*[col(c).alias(f"{c}_seen") for c in key])
        same = reduce(lambda a, b: a & b, [col(c).eqNullSafe(col(f"{c}_seen")) for c in key])
        fresh = ledger.write("rows", arrived.join(seen, same, "left_anti").select(*[col(c) for c in columns]))
        kept = stream.sparkSession.read.schema(stream.schema).parquet(fresh)
        return {"rows": [fresh], "keys": [ledger.write("keys", kept.select(*[col(c) for c in key], part).repartition("part"), by="part")]}

    def fold(number: int, tables: dict) -> dict[str, list[str]]:
        whole = ledger.read("keys", key_schema, _epoch(number), tuple(tables["keys"]))
        return {"rows": [*ledger.folders("rows", _epoch(number)), *tables["rows"]],
                "keys": [ledger.write("keys", whole.repartition("part"), by="part")]}

    _run_epochs(stream, ledger, folder, handle, fold)
    return ledger.read("rows", stream.schema)


def run_orphans(
    stream: DataFrame, fk: ForeignKey, parent: DataFrame, spread_by: Sequence[str], folder: str
) -> DataFrame:
    """Arriving rows whose reference names no row of the static parent table.

    Each batch is checked like a table: distinct references meet the parent, and a reference that
    very many rows share is spread over tasks.
    """
    ledger = Ledger(stream.sparkSession, f"{folder}/table")

    def handle(batch: DataFrame, number: int) -> dict[str, list[str]]:
        return {"orphans": [ledger.write("orphans", orphan_rows(batch, fk, parent, spread_by))]}

    _run_epochs(stream, ledger, folder, handle)
    return ledger.read("orphans", stream.schema)


def _folded_columns(bound: BoundRule) -> list[str]:
    """The columns by which a table is folded for a keyed rule."""
    if bound.rule.name == "DUPLICATE_KEY":
        return list(bound.detail)
    if bound.rule.name == "ORPHAN_REFERENCE":
        return [bound.detail.column]
    if bound.rule.name == "DATE_ORDERING":
        return [bound.detail.foreign_key, bound.detail.column]
    raise ValueError(f"{bound.rule.name} is not counted on a stream")


def _from_folded(ws: Workspace, df: DataFrame, index: int, bound: BoundRule) -> DataFrame:
    if bound.rule.name == "DUPLICATE_KEY":
        return keyed.count_duplicate_keys(df, index, bound.detail, weight="n_rows")
    parent = ws.tables[bound.detail.parent_table]
    if bound.rule.name == "ORPHAN_REFERENCE":
        return keyed.count_orphans(df, index, bound.detail, parent, weight="n_rows")
    return keyed.count_before_parent(df, index, bound.detail, parent, weight="n_rows")


def run_health(ws: Workspace, name: str, stream: DataFrame, folder: str, at: Column) -> DataFrame:
    """The health of all rows that have arrived, as a history row after every batch (column `batch_id`).

    A batch is read once for its row rules and folded to counts per key, reference and date for the others.
    Counters and counts of batches add up to those of the whole table, so duplicates and orphans across
    batches are found, and no batch reads the rows of another.
    """
    ledger = Ledger(ws.spark, f"{folder}/table")
    rules = ws.replacing({name: _empty(stream)}).bound([name])
    row_rules = [(i, b) for i, b in enumerate(rules) if b.predicate is not None]
    folds = {f"fold{i}": (i, b, _folded_columns(b)) for i, b in enumerate(rules) if b.predicate is None}

    def counters(batch: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, count_row_rules(batch, row_rules))

    def parts(batch: DataFrame) -> dict[str, DataFrame]:
        """What a batch adds, by table."""
        found = {table: keyed.key_counts(batch, columns) for table, (_, _, columns) in folds.items()}
        return {**found, "counters": counters(batch)} if row_rules else found

    def merged(table: str, df: DataFrame) -> DataFrame:
        if table == "counters":
            return df.groupBy("phase", "rule_index").agg(
                *[F.sum(c).alias(c) for c in ("affected_rows", "duplicate_groups", "total_rows")])
        return keyed.key_counts(df, folds[table][2], weight="n_rows")

    schemas = {table: df.schema for table, df in parts(_empty(stream)).items()}

    def whole(table: str, number: int, tables: dict) -> DataFrame:
        return merged(table, ledger.read(table, schemas[table], _epoch(number), tuple(tables[table])))

    def scored(number: int, tables: dict) -> DataFrame:
        branches = [_from_folded(ws, whole(table, number, tables), i, b) for table, (i, b, _) in folds.items()]
        if row_rules:
            branches.append(whole("counters", number, tables))
        done = Scan(ws, rules, reduce(DataFrame.unionByName, branches))
        rows = records.scan_history_rows(done.scores, DATABASE, SCHEMA, at)
        return rows.withColumn("batch_id", F.lit(number).cast("long"))

    def handle(batch: DataFrame, number: int) -> dict[str, list[str]]:
        tables = {table: [ledger.write(table, df)] for table, df in parts(batch).items()}
        return {**tables, "history": [ledger.write("history", scored(number, tables))]}

    def fold(number: int, tables: dict) -> dict[str, list[str]]:
        folded = {table: [ledger.write(table, whole(table, number, tables))] for table in schemas}
        return {**folded, "history": [*ledger.folders("history", _epoch(number)), *tables["history"]]}

    empty = {table: [ledger.write(table, df)] for table, df in parts(_empty(stream)).items()}
    history_schema = scored(0, empty).schema
    _run_epochs(stream, ledger, folder, handle, fold)
    return ledger.read("history", history_schema)
