"""Audit rows about runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

AUDIT_SCHEMA = (
    "event string, pipeline string, run_id string, ts timestamp, "
    "metrics map<string,bigint>, extra map<string,string>"
)


def log_event(
    spark: SparkSession,
    path: str,
    event: str = "mark",
    pipeline: str = "",
    run_id: str = "",
    metrics: Mapping[str, int] | None = None,
    extra: Mapping[str, str] | None = None,
) -> dict:
    """Append one row to the parquet audit table at `path`; returns the payload.

    `metrics` are numbers about the run, such as what an `Observation` collected during a write.
    """
    payload = {"pipeline": pipeline, "run_id": run_id, "metrics": dict(metrics or {}), "extra": dict(extra or {})}
    now = dt.datetime.now(dt.timezone.utc)
    row = (event, pipeline, run_id, now, payload["metrics"], payload["extra"])
    spark.createDataFrame([row], AUDIT_SCHEMA).write.mode("append").parquet(path)
    return payload


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


STREAM_SCHEMA = (
    "pipeline string, query_id string, batch_id long, ts string, rows_in long, rows_out long, rows_late long"
)
OBSERVED = "audit"


def observed(df: DataFrame) -> DataFrame:
    """A stream whose rows are counted as they pass, for `log_stream`."""
    return df.observe(OBSERVED, F.count(F.lit(1)).alias("rows_out"))


def log_stream(spark: SparkSession, query: StreamingQuery, path: str, pipeline: str = "") -> int:
    """Write what `query` tells of its batches to the audit table at `path`; returns how many there were.

    A row for each batch: rows read, rows that passed `observed` (null without it), and rows that came
    too late for the watermark. A batch has a folder of its own, which is replaced if it is logged
    again. Spark remembers the last `spark.sql.streaming.numRecentProgressUpdates` reports, so a stream that
    goes on has to be logged once in so many batches.
    """
    batches = {}
    for report in query.recentProgress:
        counts = report.observedMetrics.get(OBSERVED)
        late = sum(state.numRowsDroppedByWatermark for state in report.stateOperators)
        row = (pipeline, str(report.id), report.batchId, report.timestamp, report.numInputRows, counts and counts.rows_out, late)
        # An idle query reports its last batch again, without rows.
        if report.batchId not in batches or report.numInputRows:
            batches[report.batchId] = row
    if batches:
        rows = spark.createDataFrame(list(batches.values()), STREAM_SCHEMA).coalesce(1)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("query_id", "batch_id").parquet(path)
    return len(batches)


def read_stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STREAM_SCHEMA).parquet(path)
