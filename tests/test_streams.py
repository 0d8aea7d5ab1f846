"""Streams give what the same data gives as a table, also when it arrives in parts."""

import pytest
from pyspark.sql import functions as F

from plumbline.binding import col
from plumbline.config import open_workspace
from plumbline.operators import records
from plumbline.operators.rowscan import count_row_rules
from plumbline.plans.cycle import DATABASE, SCHEMA
from plumbline.plans.scan import scan
from plumbline.sources.defects import dirty_events
from plumbline.sources.store import shared_folder
from plumbline.streaming import monitors
from tests.conftest import rows


@pytest.fixture(scope="module")
def ws(spark, data_dir):
    return open_workspace(spark, data_dir)


@pytest.fixture
def arriving(spark, ws):
    """A folder that receives the events in three parts, and the function that lets one arrive."""
    folder = shared_folder(spark, "arriving")
    ordered = ws.tables["events"].orderBy("ts").coalesce(1)
    parts = [ordered.where(F.col("event_id") % 3 == i) for i in range(3)]

    def arrive(i):
        parts[i].write.mode("append").parquet(f"{folder}/events.parquet")

    return folder, arrive


def stream_of(ws, folder):
    raw = monitors.read_stream(ws.spark, folder, "events", ws.tables["events"].schema)
    return dirty_events(raw)


def test_a_restarted_stream_goes_on(spark, ws, arriving):
    """Orphans of three runs over a growing folder are those of the whole table, each once."""
    folder, arrive = arriving
    out = shared_folder(spark, "orphans")
    fk = ws.binding("events_dirty").foreign_keys[0]
    for i in range(3):
        arrive(i)
        arrived = stream_of(ws, folder).select("event_id", "user_id")
        kept = monitors.run_orphans(arrived, fk, ws.tables["customer"], ["event_id"], out)
    wanted = ws.tables["events_dirty"].where("user_id IS NOT NULL").join(
        ws.tables["customer"], col("user_id") == col("c_custkey"), "left_anti").select("event_id", "user_id")
    assert rows(kept, "event_id", "user_id") == rows(wanted)


def test_window_counts_grow_with_arrivals(spark, ws, arriving):
    folder, arrive = arriving
    out = shared_folder(spark, "windows")
    rules = ws.bound(["events_dirty"])
    for i in range(3):
        arrive(i)
        stream = monitors.with_event_time(stream_of(ws, folder), "ts")
        kept = monitors.run_to_latest(monitors.window_counts(stream, rules), out)
    numbered = [(i, b) for i, b in enumerate(rules) if b.predicate is not None]
    whole = ws.tables["events_dirty"].withColumn("window_start", F.expr("CAST(date(ts) AS timestamp_ntz)"))
    wanted = count_row_rules(whole, numbered, by=("window_start",))[0]
    columns = ("window_start", "rule_index", "affected_rows", "total_rows")
    assert rows(kept, *columns) == rows(wanted, *columns)


def test_first_occurrences_across_arrivals(spark, ws, arriving):
    folder, arrive = arriving
    out = shared_folder(spark, "first")
    for i in range(3):
        arrive(i)
        stream = monitors.with_event_time(stream_of(ws, folder), "ts", watermark="60 days")
        kept = monitors.run_to_table(
            monitors.first_occurrences(stream, ["event_id"], within_watermark=True).select("event_id"), out)
    assert rows(kept) == rows(ws.tables["events"], "event_id")


def test_first_occurrences_that_arrive_late_are_kept(spark, tmp_path):
    """200 ids one hour apart, in two files of which the newest arrives first."""
    out, landing = shared_folder(spark, "late"), str(tmp_path / "landing")
    ids = spark.range(200).selectExpr("id AS event_id", "timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts")
    for part in ("event_id >= 100", "event_id < 110"):
        ids.where(part).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(ids.schema).parquet(landing)
        kept = monitors.run_to_table(monitors.first_occurrences(stream, ["event_id"]), out)
    assert rows(kept, "event_id") == sorted(((i,) for i in range(200)), key=repr)


def test_health_after_every_batch_is_that_of_all_rows(spark, ws, arriving):
    """Duplicates and orphans across batches included; the newest row is the scan of the whole table."""
    folder, arrive = arriving
    out, at = shared_folder(spark, "health"), F.lit("2024-06-01").cast("date")
    for i in range(3):
        arrive(i)
        kept = monitors.run_health(ws, "events_dirty", stream_of(ws, folder), out, at)
    assert rows(kept, "batch_id", "table_name") == [(i, "events_dirty") for i in range(3)]
    wanted = records.scan_history_rows(scan(ws, ["events_dirty"]).scores, DATABASE, SCHEMA, at)
    assert rows(kept.where("batch_id = 2").drop("batch_id")) == rows(wanted)


def test_copies_in_different_batches_are_duplicates(spark, ws, tmp_path):
    events = ws.tables["events_dirty"].limit(40).cache()
    events.write.parquet(str(tmp_path / "landing"))
    events.write.mode("append").parquet(str(tmp_path / "landing"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landing"))
    kept = monitors.run_health(ws, "events_dirty", stream, shared_folder(spark, "copies"), F.lit("2024-06-01").cast("date"))
    assert [r.critical_issues for r in kept.orderBy("batch_id").collect()][-1] >= 1
    first = monitors.run_first_occurrences(stream, ["event_id"], shared_folder(spark, "copies"), parts=4)
    assert rows(first, "event_id") == rows(events.select("event_id").distinct())


def test_streams_without_files_give_empty_tables(spark, ws, tmp_path):
    schema = ws.tables["events_dirty"].schema
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    fk = ws.binding("events_dirty").foreign_keys[0]
    timed = stream.withColumn(monitors.EVENT_TIME, monitors.event_time("ts"))
    for kept in (
        monitors.run_orphans(stream, fk, ws.tables["customer"], ["event_id"], shared_folder(spark, "none")),
        monitors.run_health(ws, "events_dirty", stream, shared_folder(spark, "none"), F.lit("2024-06-01").cast("date")),
        monitors.run_first_occurrences(stream, ["event_id"], shared_folder(spark, "none")),
        monitors.run_window_counts(timed, ws.bound(["events_dirty"]), shared_folder(spark, "none")),
    ):
        assert kept.count() == 0


def test_window_counts_of_batches_add_up(spark, ws, arriving, monkeypatch):
    """Three batches, folded after each second one, and more rules than one aggregate counts."""
    monkeypatch.setattr(monitors, "FOLD_EVERY", 2)
    folder, arrive = arriving
    out = shared_folder(spark, "added")
    rules = [b for b in ws.bound(["events_dirty"]) if b.predicate is not None] * 12
    assert len(rules) > 100
    for i in range(3):
        arrive(i)
        timed = stream_of(ws, folder).withColumn(monitors.EVENT_TIME, monitors.event_time("ts"))
        kept = monitors.run_window_counts(timed, rules, out)
    whole = ws.tables["events_dirty"].withColumn("window_start", F.expr("CAST(date(ts) AS timestamp_ntz)"))
    columns = ("window_start", "rule_index", "affected_rows", "total_rows")
    wanted = [r for part in count_row_rules(whole, list(enumerate(rules)), by=("window_start",)) for r in rows(part, *columns)]
    assert rows(kept, *columns) == sorted(wanted, key=repr)
    final = kept.groupBy("window_start").agg(F.min("is_final").alias("f"), F.max("is_final").alias("g")).orderBy("window_start").collect()
    assert all(r.f == r.g for r in final) and [r.f for r in final][-1] is False and [r.f for r in final][0] is True


def test_a_batch_that_is_run_twice_counts_once(spark, ws, arriving):
    """The same files handed over again under the same number, as after a lost checkpoint commit."""
    folder, arrive = arriving
    arrive(0)
    out = shared_folder(spark, "twice")
    rules = ws.bound(["events_dirty"])
    seen = []
    for attempt in range(2):
        stream = stream_of(ws, folder).withColumn(monitors.EVENT_TIME, monitors.event_time("ts"))
        kept = monitors.run_window_counts(stream, rules, out)
        first = monitors.run_first_occurrences(stream_of(ws, folder), ["event_id"], out + "-first")
        seen.append((rows(kept), rows(first)))
        for checkpoint in (out, out + "-first"):  # the stream forgets that it ran
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/checkpoint")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    assert seen[0] == seen[1]


def test_the_index_of_keys_keeps_late_and_null_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monitors, "FOLD_EVERY", 2)
    out, landing = shared_folder(spark, "index"), str(tmp_path / "landing")
    for ids in ([5, 6, None], [1, 5], [None, 2, 6], [1, 2, 3], [3, 3]):
        spark.createDataFrame([(i, str(i)) for i in ids], "k long, v string").coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("k long, v string").parquet(landing)
        kept = monitors.run_first_occurrences(stream, ["k"], out, parts=3)
    assert rows(kept) == sorted([(i, str(i)) for i in (None, 1, 2, 3, 5, 6)], key=repr)


def test_event_time_ignores_the_session_zone(spark, ws):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = set()
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            windows = ws.tables["events"].withColumn("e", monitors.event_time("ts")).select(
                F.window("e", "1 day").alias("w")).select(monitors.without_zone("w.start").alias("s")).distinct()
            seen.add(tuple(r[0] for r in rows(windows)))
        assert len(seen) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_closed_windows_are_appended_once(spark, ws, arriving):
    """In append mode a window is written when the watermark has passed it; only the last is held back."""
    folder, arrive = arriving
    out = shared_folder(spark, "closed")
    rules = ws.bound(["events_dirty"])
    for i in range(3):
        arrive(i)
    stream = monitors.with_event_time(stream_of(ws, folder), "ts")
    kept = monitors.run_to_table(monitors.window_counts(stream, rules), out)
    days = ws.tables["events"].select(F.expr("CAST(date(ts) AS timestamp_ntz)").alias("d")).distinct()
    assert rows(kept.select("window_start").distinct()) == rows(days.orderBy("d").limit(days.count() - 1))
    assert kept.count() == kept.select("window_start", "rule_index").distinct().count()
