"""Streams over the event files, run until all there is has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pipekit.operators.clean import add_batch_columns, fill_nulls, normalize_text
from pipekit.operators.schema import cast_types, parse_time
from pipekit.plans.audit import log_stream, observed, read_stream_log
from pipekit.queries.registry import ORACLES, QUERIES, Query
from pipekit.session import fresh_path, tune
from pipekit.streaming.tables import (
    batch_folders,
    drop_old_parts,
    latest_parts,
    read_stream,
    replace_parts,
    replace_table,
    stream_aggregate,
    stream_deduplicate,
    stream_to,
    write_stream,
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, so that the table may be one file or a folder of files.
    return read_stream(spark, "parquet", f"{sf_dir}/events.parque[t]", schema)


def _register(name: str, sql: str):
    def register(function: Query) -> Query:
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return register


@_register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay covers the whole table, so each key comes out once."""
    unique = stream_deduplicate(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days")
    path = fresh_path(spark, "stream")
    write_stream(unique, path, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("user_id", "event_type")


@_register(
    "stream_hourly",
    """
    SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
           event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS hi
    FROM events GROUP BY ALL
    """,
)
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = {
        "n": {"op": "count"},
        "total": {"op": "sum", "col": "value"},
        "hi": {"op": "max", "col": "value"},
    }
    hourly = stream_aggregate(_events(spark, sf_dir), "ts", "1 hour", metrics, ["event_type"])
    path = fresh_path(spark, "stream")
    stream_to(hourly, replace_table(path), fresh_path(spark, "checkpoint"), "complete").awaitTermination()
    windows = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return spark.read.parquet(path).withColumns({**windows, "total": F.round("total", 2)})


@_register(
    "stream_hourly_append",
    """
    WITH late AS (SELECT max(ts) - INTERVAL 1 HOUR AS watermark FROM events)
    SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n
    FROM events, late
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= watermark GROUP BY ALL
    """,
)
def stream_hourly_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows come out, and leave the state, once the watermark has passed their end."""
    hourly = stream_aggregate(_events(spark, sf_dir), "ts", "1 hour", {"n": {"op": "count"}}, ["event_type"])
    path = fresh_path(spark, "stream")
    write_stream(hourly, path, fresh_path(spark, "checkpoint")).awaitTermination()
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return spark.read.schema(hourly.schema).parquet(path).select(start, "event_type", "n")


@_register(
    "stream_clean",
    """
    SELECT event_id, date_trunc('hour', ts) AS ts, strftime(ts, '%Y-%m') AS ts_cohort,
           CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS event_type,
           CAST(event_id AS INTEGER) AS small, 'stream-1' AS processing_batch_id
    FROM events
    """,
)
def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row-wise operators, unchanged, on a stream."""
    kind = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("\t "), F.upper("event_type")))
    events = _events(spark, sf_dir).select("event_id", "ts", kind.alias("event_type"), F.col("event_id").alias("small"))
    events = fill_nulls(events, "unknown", ["event_type"])
    events = normalize_text(events, ["event_type"])
    events = cast_types(events, {"small": "Int32"})
    events = add_batch_columns(parse_time(events, "ts", round_to="hour"), "stream-1").drop("processed_at")
    path = fresh_path(spark, "stream")
    stream_to(events, batch_folders(path), fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).drop("batch_id")


@_register(
    "stream_daily_update",
    """
    SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY ALL
    """,
)
def stream_daily_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch hands over the windows it changes, and only their days are written again."""
    events = _events(spark, sf_dir)
    metrics = {"n": {"op": "count"}, "hi": {"op": "max", "col": "value"}}
    daily = stream_aggregate(events, "ts", "1 day", metrics, ["event_type"], delay="60 days")
    path = fresh_path(spark, "stream")
    write = replace_parts(path, ["window_start", "event_type"], lambda b: F.date_format("window_start", "yyyy-MM-dd"))
    stream_to(daily, write, fresh_path(spark, "checkpoint"), "update").awaitTermination()
    drop_old_parts(spark, path)
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return latest_parts(spark, path).select(start, "event_type", "n", "hi")


@_register(
    "stream_audit",
    """
    SELECT 'events' AS pipeline, count(*) AS rows_in, count(*) FILTER (event_type = 'error') AS rows_out, 0 AS rows_late
    FROM events
    """,
)
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch read and passed on, logged twice and there once."""
    errors = observed(_events(spark, sf_dir).where("event_type = 'error'"))
    path = fresh_path(spark, "audit")
    query = write_stream(errors, fresh_path(spark, "stream"), fresh_path(spark, "checkpoint"))
    query.awaitTermination()
    for _ in range(2):
        log_stream(spark, query, path, "events")
    counts = [F.sum(c).alias(c) for c in ("rows_in", "rows_out", "rows_late")]
    return read_stream_log(spark, path).groupBy("pipeline").agg(*counts)
