"""Streaming sources, stateful operators and sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from pipekit.functions.metrics import metric
from pipekit.operators.keys import named, require
from pipekit.session import saved

FILE_FORMATS = ("csv", "json", "parquet")

# Metric ops that keep a small state per group and window.
STREAM_METRICS = ("sum", "count", "avg", "mean", "min", "max", "stddev", "var", "approx_count_distinct")


def read_stream(
    spark: SparkSession,
    fmt: str,
    path: str | None = None,
    schema: T.StructType | str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A stream of `kafka` messages or of the files that appear at `path` (which need a schema)."""
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        try:
            return reader.load()
        except PySparkException as error:
            if "kafka" in str(error).lower() and "data source" in str(error).lower():
                raise ValueError("the Kafka connector is not on the class path") from error
            raise
    if fmt not in FILE_FORMATS:
        raise ValueError(f"stream format must be 'kafka' or one of {list(FILE_FORMATS)}, not {fmt!r}")
    if schema is None or path is None:
        raise ValueError("a file stream needs a path and a schema")
    return reader.schema(schema).load(path)


def _event_time(df: DataFrame, ts_col: str, delay: str) -> DataFrame:
    require(df, [ts_col])
    if isinstance(df.schema[ts_col].dataType, T.TimestampNTZType):
        df = df.withColumn(ts_col, named(ts_col).cast("timestamp"))
    return df.withWatermark(ts_col, delay)


def stream_deduplicate(
    df: DataFrame, keys: Sequence[str], ts_col: str, delay: str, keep: str = "first", spread: int = 16
) -> DataFrame:
    """The first arrival per key; a repeat is recognised for `delay` after it.

    Only `keep="first"`: a row already sent on cannot be taken back. Copies within one
    micro-batch are first dropped in `spread` parts of each key, so that a very frequent key is
    not one task's work and the second step sees at most `spread` rows of it for each batch;
    `spread=1` does it in one step.
    """
    if keep != "first":
        raise ValueError("a stream can only keep the first row of a key")
    require(df, keys)
    timed = _event_time(df, ts_col, delay)
    if spread > 1:
        # The batch's time is part of the key: a row of a later batch is never a copy here, so
        # that only the second step, which knows all rows sent on, decides when a key may return.
        parts = timed.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(spread)))
        parts = parts.withColumn("__batch", F.current_timestamp())
        timed = parts.dropDuplicatesWithinWatermark([*keys, "__part", "__batch"]).drop("__part", "__batch")
    return timed.dropDuplicatesWithinWatermark(list(keys))


def stream_aggregate(
    df: DataFrame,
    ts_col: str,
    every: str,
    metrics: Mapping[str, Mapping[str, Any]],
    group_by: Sequence[str] = (),
    delay: str = "1 hour",
) -> DataFrame:
    """Metrics per time window (`window_start`, `window_end`) and group.

    Rows are combined per task before the shuffle. In append mode a window comes out once the
    watermark has passed its end, and rows later than `delay` may be dropped.
    """
    odd = sorted({m["op"] for m in metrics.values()} - set(STREAM_METRICS))
    if odd:
        raise ValueError(f"metric ops {odd} keep no small state; a stream takes {list(STREAM_METRICS)}")
    timed = _event_time(df, ts_col, delay)
    windows = timed.groupBy(F.window(named(ts_col), every).alias("window"), *[named(g) for g in group_by])
    result = windows.agg(*[metric(m).alias(name) for name, m in metrics.items()])
    return result.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *[named(c) for c in result.columns if c != "window"],
    )


def _started(writer: DataStreamWriter, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Start the stream: all that is there now, or every `interval`."""
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    interval: str | None = None,
) -> StreamingQuery:
    """Append a stream to files; after a restart every row is there exactly once."""
    writer = df.writeStream.format(fmt).outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _started(writer, checkpoint, interval)


def stream_to(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
    interval: str | None = None,
) -> StreamingQuery:
    """Hand each micro-batch to `write(batch, batch_id)`.

    A batch is handed over again after a failure, under the same id: `write` must replace what
    it wrote for that id before, as `replace_table` and `batch_folders` do.
    """
    return _started(df.writeStream.outputMode(output_mode).foreachBatch(write), checkpoint, interval)


def replace_table(path: str) -> Callable[[DataFrame, int], None]:
    """For `stream_to` in complete mode: the table at `path` is always the latest result."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(path)


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """For `stream_to` in append mode: each batch has its own folder, replaced if it comes again."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


# Folder columns of a table that is replaced by parts: the part, and the batch that wrote it last.
PART, BATCH = "part", "batch"


def latest_parts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The rows of a table written by `replace_parts`: of each part what its last batch wrote.

    `before` leaves out that batch and later ones.
    """
    rows = spark.read.option("basePath", path).parquet(path).withColumn(PART, F.col(PART).cast("string"))
    rows = rows.withColumn(BATCH, F.col(BATCH).cast("long"))
    if before is not None:
        rows = rows.where(F.col(BATCH) < before)
    last = rows.groupBy(PART).agg(F.max(BATCH).alias(BATCH))
    return rows.join(last, [PART, BATCH], "left_semi").drop(BATCH)


def replace_parts(path: str, keys: Sequence[str], part: Callable[[DataFrame], Column]) -> Callable[[DataFrame, int], None]:
    """For `stream_to` in update mode: a table of the latest values by `keys`, in parts.

    Only parts that a batch changes are written, each to a folder of that batch, with the rows of its
    keys that did not change; other files stay as they are. A batch that comes again starts from what
    earlier ones left and replaces its own folders, so that a lost batch does no harm. `part` gives
    each row's part as text; rows of a key must stay in one part. `latest_parts` reads the table, and
    `drop_old_parts` deletes what later batches have replaced.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = saved(batch.withColumn(PART, part(batch)), "batch")
        whole = changed
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(target) and any(f.getPath().getName().startswith(f"{PART}=") for f in files.listStatus(target)):
            old = latest_parts(spark, path, batch_id).join(changed.select(PART).distinct(), PART, "left_semi")
            renamed = changed.select(*[named(k).alias(f"__{k}") for k in keys])
            same = [named(k).eqNullSafe(named(f"__{k}")) for k in keys]
            whole = changed.unionByName(old.join(renamed, reduce(Column.__and__, same), "left_anti"))
        writer = whole.withColumn(BATCH, F.lit(batch_id)).repartition(PART).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(PART, BATCH).parquet(path)

    return write


def drop_old_parts(spark: SparkSession, path: str) -> int:
    """Delete the folders that a later batch has replaced; returns how many. Call it while nothing reads the table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for folder in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(target, f"{PART}=*")):
        batches = [f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith(f"{BATCH}=")]
        for old in sorted(batches, key=lambda p: int(p.getName().split("=")[1]))[:-1]:
            gone += bool(files.delete(old, True))
    return gone
