"""File and lake sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, functions as F

from pipekit.operators.keys import named
from pipekit.session import fresh_path, saved
from pipekit.sources.files import storage_uri

MODES = ("append", "overwrite", "error", "ignore")
LAKE_FORMATS = ("parquet", "delta", "iceberg")
EXPORT_FORMATS = ("csv", "json")


def write_datalake(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    storage: str | None = None,
    mode: str = "append",
    seen: Observation | None = None,
) -> int | None:
    """Write a lake table, in folders `column=value` if `partition_by` is given.

    The rows are rebalanced by the partition columns first: small ones share a file and a hot
    one is split over tasks. `overwrite` replaces only the partitions that are written.
    `delta` and `iceberg` need their connector on the class path. Returns the number of rows
    written, which `seen` gets as `rows`; None if `ignore` wrote nothing.
    """
    if fmt not in LAKE_FORMATS:
        raise ValueError(f"lake format must be one of {list(LAKE_FORMATS)}, not {fmt!r}")
    _check_mode(mode)
    if partition_by:
        df = df.hint("rebalance", *[F.col(f"`{p}`") for p in partition_by])
    seen = seen or Observation()
    writer = counted(df, seen).write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
        if fmt == "parquet":
            writer = writer.option("partitionOverwriteMode", "dynamic")
    try:
        writer.save(storage_uri(path, storage))
    except (PySparkException, Py4JError) as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error):
            raise ValueError(f"the {fmt} connector is not on the class path") from error
        raise
    return _rows(seen, mode)


def export_files(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    options: Mapping[str, str] | None = None,
    storage: str | None = None,
    mode: str = "error",
    seen: Observation | None = None,
) -> int | None:
    """Write CSV (with a header, quotes doubled) or JSON lines, one file per task.

    Returns the number of rows written, which `seen` gets as `rows`; None if `ignore` wrote nothing.
    """
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"export format must be one of {list(EXPORT_FORMATS)}, not {fmt!r}")
    _check_mode(mode)
    defaults = {"header": "true", "escape": '"'} if fmt == "csv" else {}
    seen = seen or Observation()
    writer = counted(df, seen).write.format(fmt).mode(mode)
    writer.options(**{**defaults, **(options or {})}).save(storage_uri(path, storage))
    return _rows(seen, mode)


def _rows(seen: Observation, mode: str) -> int | None:
    # An `ignore` that finds the target runs no job, and the observation would wait for ever.
    return None if mode == "ignore" else seen.get["rows"]


def counted(df: DataFrame, seen: Observation | None) -> DataFrame:
    """Count the rows of `df` into `seen` while they are written.

    The count sits in the writing stage itself, after the last shuffle: Spark counts a task of
    that stage once even if it has to run again, which it does not promise for earlier ones.
    """
    return df if seen is None else df.observe(seen, F.count(F.lit(1)).alias("rows"))


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {list(MODES)}, not {mode!r}")


def write_checked(write: Callable[[Observation], None], read: Callable[[], DataFrame]) -> dict[str, int]:
    """Run `write(seen)`, a sink call that passes `seen` on, and count.

    Returns the rows written, observed as they pass by, and the rows of the target `read()`.
    """
    seen = Observation()
    write(seen)
    return {"rows_written": seen.get["rows"], "target_rows": read().count()}


def stage(df: DataFrame) -> DataFrame:
    """Write the table once to the shared folder and go on from there."""
    return saved(df, "stage")


def stage_buckets(df: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    """Write the table once to the shared folder, dealt out and sorted by `by`, and go on from there.

    Joins and aggregates on `by` between tables with the same number of buckets need no shuffle. A
    bucket is one file and one task, so that `buckets` should follow the size of the table, and a key
    with a large part of all rows is better joined without them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "buckets")
    name = "staged_" + path.rsplit("-", 1)[-1]
    dealt = df.repartition(buckets, *[named(c) for c in by])
    dealt.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return spark.table(name)
