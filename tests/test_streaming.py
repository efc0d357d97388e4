import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pipekit.operators.aggregate import aggregate
from pipekit.operators.clean import add_batch_columns, fill_nulls, normalize_text, standardize_text
from pipekit.operators.schema import cast_types, parse_time
from pipekit.plans.audit import log_stream, observed, read_stream_log
from pipekit.streaming.tables import (
    drop_old_parts,
    latest_parts,
    replace_parts,
    batch_folders,
    read_stream,
    replace_table,
    stream_aggregate,
    stream_deduplicate,
    stream_to,
    write_stream,
)

SCHEMA = "event_id bigint, ts timestamp, user_id bigint"


@pytest.fixture
def late(spark, tmp_path):
    """Four files, read one per batch: on time, late within the delay, later, and too late."""
    folder = tmp_path / "in"

    def put(n, *data):
        parsed = [(i, dt.datetime.fromisoformat(t), u) for i, t, u in data]
        spark.createDataFrame(parsed, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    put(1, (1, "2024-01-01T10:00:00", 1), (2, "2024-01-01T10:10:00", 2), (2, "2024-01-01T10:10:00", 2))
    put(2, (3, "2024-01-01T10:50:00", 1), (1, "2024-01-01T10:00:00", 1), (4, "2024-01-01T13:00:00", 1))
    put(3, (6, "2024-01-01T13:30:00", 2), (7, "2024-01-01T16:00:00", 2))
    put(4, (5, "2024-01-01T10:20:00", 9))
    return lambda: read_stream(
        spark, "parquet", str(folder), SCHEMA, {"maxFilesPerTrigger": "1", "latestFirst": "false"}
    )


@pytest.mark.parametrize("spread", [1, 16])
def test_dedup_keeps_the_first_arrival(spark, late, tmp_path, spread):
    unique = stream_deduplicate(late(), ["event_id"], "ts", "1 hour", spread=spread)
    write_stream(unique, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = [r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(out) == len(set(out)) and {1, 2, 3, 4, 6, 7} <= set(out)
    with pytest.raises(ValueError):
        stream_deduplicate(late(), ["event_id"], "ts", "1 hour", keep="last")


@pytest.mark.parametrize("spread", [1, 2, 16])
def test_a_key_may_return_after_the_delay(spark, tmp_path, spread):
    """However copies are thinned out, what comes out is what one step would send on."""
    # The other key moves the watermark on.
    for k, time in ((1, "10:00"), (1, "10:30"), (2, "12:00"), (2, "12:10"), (1, "12:15"), (1, "12:20")):
        at = dt.datetime.fromisoformat(f"2024-01-01T{time}")
        spark.createDataFrame([(k, at)], "k int, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = read_stream(spark, "parquet", f"{tmp_path}/in", "k int, ts timestamp", {"maxFilesPerTrigger": "1"})
    unique = stream_deduplicate(stream, ["k"], "ts", "1 hour", spread=spread)
    write_stream(unique, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").where("k = 1").select(F.date_format("ts", "HH:mm"))
    assert rows(out) == [("10:00",), ("12:15",)]


def test_a_hot_key_is_spread_before_it_is_one_task(spark, tmp_path):
    """The second of the two steps sees one row of each key per part, however many there are."""
    rows_in = spark.range(0, 20_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "timestamp_seconds(1700000000 + id % 60) AS ts"
    )
    rows_in.write.parquet(f"{tmp_path}/in")
    stream = read_stream(spark, "parquet", f"{tmp_path}/in", "k bigint, ts timestamp")
    query = write_stream(stream_deduplicate(stream, ["k"], "ts", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    first = next(p for p in query.recentProgress if p["numInputRows"])
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert kept.count() == kept.select("k").distinct().count() == 13_334
    last, spread = (state["numRowsTotal"] for state in first["stateOperators"])
    assert last == 13_334 and 13_334 <= spread <= 13_333 + 16


def test_windows_close_behind_the_watermark(spark, late, tmp_path):
    """Row 5 comes after its window is closed and is dropped; the last window stays open."""
    hourly = stream_aggregate(late(), "ts", "1 hour", {"n": {"op": "count"}}, delay="1 hour")
    write_stream(hourly, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = {r.window_start.hour: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {10: 5, 13: 2}


def test_complete_mode_equals_batch(spark, table, tmp_path):
    metrics = {
        "n": {"op": "count"},
        "hi": {"op": "max", "col": "value"},
        "lo": {"op": "min", "col": "value"},
    }
    events = table("events")
    stream = read_stream(spark, "parquet", "/root/testdata/sf0.001/events.parque[t]", events.schema)
    hourly = stream_aggregate(stream, "ts", "1 hour", metrics, ["event_type"])
    stream_to(hourly, replace_table(f"{tmp_path}/out"), f"{tmp_path}/cp", "complete").awaitTermination()
    batch = aggregate(
        events.withColumn("window_start", F.window("ts", "1 hour").start.cast("timestamp")),
        ["window_start", "event_type"],
        metrics,
    )
    assert rows(spark.read.parquet(f"{tmp_path}/out").drop("window_end")) == rows(batch)


def test_rowwise_operators_on_a_stream(spark, tmp_path):
    data = [("1,000", " o'neil \t", "2024-01-01 10:59:00", None), ("x", None, "bad", "😀B")]
    spark.createDataFrame(data, "n string, city string, at string, t string").write.parquet(f"{tmp_path}/in")

    def clean(df):
        df = normalize_text(fill_nulls(df, "-", ["t"]), ["t"])
        df = parse_time(cast_types(standardize_text(df), {"n": "Int64"}), "at", round_to="hour")
        return add_batch_columns(df, "b").drop("processed_at")

    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = read_stream(spark, "parquet", f"{tmp_path}/in", batch.schema)
    stream_to(clean(stream), batch_folders(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out").drop("batch_id")) == rows(clean(batch))


def test_a_restart_goes_on_where_it_stopped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")

    def run():
        stream = read_stream(spark, "parquet", f"{tmp_path}/in", "id bigint")
        write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    assert run() == run() == [(0,), (1,), (2,)]
    spark.range(3, 5).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == [(0,), (1,), (2,), (3,), (4,)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = batch_folders(f"{tmp_path}/out")
    for _ in range(2):
        write(spark.range(3), 0)
        write(spark.range(3, 4), 1)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_partitioned_stream(spark, tmp_path):
    spark.range(6).write.parquet(f"{tmp_path}/in")
    stream = read_stream(spark, "parquet", f"{tmp_path}/in", "id bigint").withColumn("p", F.col("id") % 2)
    write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", partition_by=["p"]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").filter("p = 1").count() == 3


def test_rejections(spark, late):
    with pytest.raises(ValueError, match="class path"):
        read_stream(spark, "kafka", options={"kafka.bootstrap.servers": "h:1", "subscribe": "t"})
    with pytest.raises(ValueError):
        read_stream(spark, "parquet", "/tmp")
    with pytest.raises(ValueError):
        read_stream(spark, "xlsx", "/tmp", SCHEMA)
    with pytest.raises(ValueError):
        stream_aggregate(late(), "ts", "1 hour", {"m": {"op": "median", "col": "user_id"}})


def test_only_changed_parts_are_written_again(spark, tmp_path):
    """Untouched files keep their times, a batch that comes again changes nothing, and old folders go."""
    path = f"{tmp_path}/table"
    write = replace_parts(path, ["k"], lambda b: F.col("day"))
    batch = lambda *data: spark.createDataFrame(list(data), "k int, day string, v int")
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}
    write(batch((1, "mon", 1), (2, "mon", 2), (3, "tue", 3), (None, "wed", 9)), 0)
    first = files()
    for _ in range(2):  # as after a lost batch
        write(batch((2, "mon", 20), (4, "mon", 4), (None, "wed", 10)), 1)
        want = [(None, "wed", 10), (1, "mon", 1), (2, "mon", 20), (3, "tue", 3), (4, "mon", 4)]
        assert rows(latest_parts(spark, path), "k", "day", "v") == want
    assert all(files()[f] == first[f] for f in first)
    assert len({f.parent for f in files()}) == 5
    assert drop_old_parts(spark, path) == 2 and drop_old_parts(spark, path) == 0
    assert rows(latest_parts(spark, path), "k", "day", "v") == want


def test_updates_of_a_stream_over_restarts(spark, tmp_path):
    source, path, checkpoint = (f"{tmp_path}/{name}" for name in ("in", "out", "checkpoint"))
    events = spark.range(200).selectExpr("timestamp_seconds(id * 3000) AS ts", "id % 3 AS kind", "id AS v")
    for i in range(4):
        events.where(f"id % 4 = {i}").write.mode("append").parquet(source)
        stream = read_stream(spark, "parquet", source, events.schema)
        daily = stream_aggregate(stream, "ts", "1 day", {"n": {"op": "count"}}, ["kind"], "30 days")
        write = replace_parts(path, ["window_start", "kind"], lambda b: F.date_format("window_start", "yyyy-MM-dd"))
        stream_to(daily, write, checkpoint, "update").awaitTermination()
    want = events.groupBy(F.window("ts", "1 day").start.alias("window_start"), "kind").count()
    assert rows(latest_parts(spark, path), "window_start", "kind", "n") == rows(want)


def test_audit_of_late_rows_by_batch(spark, tmp_path):
    source, log = f"{tmp_path}/in", f"{tmp_path}/log"
    events = spark.range(100).selectExpr("timestamp_seconds(id * 3600) AS ts", "id AS v")
    checkpoint = f"{tmp_path}/checkpoint"
    seen = []
    for part in ("id >= 50", "id < 50", "id = 99"):
        events.where(part.replace("id", "v")).write.mode("append").parquet(source)
        stream = read_stream(spark, "parquet", source, events.schema)
        hourly = observed(stream_aggregate(stream, "ts", "1 hour", {"n": {"op": "count"}}, delay="1 hour"))
        query = write_stream(hourly, f"{tmp_path}/out", checkpoint)
        query.awaitTermination()
        assert log_stream(spark, query, log, "late") >= 1
        seen.append(read_stream_log(spark, log).agg(F.sum("rows_in"), F.sum("rows_out"), F.sum("rows_late")).first())
    assert [r[0] for r in seen] == [50, 100, 101]
    assert seen[-1][2] == 50  # all of the second batch, each an hour of its own
    assert seen[-1][1] == spark.read.parquet(f"{tmp_path}/out").count()
    batches = read_stream_log(spark, log).select("batch_id").collect()
    assert len(batches) == len(set(batches))
