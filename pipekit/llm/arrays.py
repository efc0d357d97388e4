"""Arrow columns of text as flat numpy bytes, and batches of bounded size."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from pipekit.operators.keys import named

# Text bytes that a task works on at once; a single longer text is a batch of its own.
BATCH_BYTES = 2 * 1024 * 1024


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    """The texts as bytes objects; null is empty."""
    data, offsets = flat(column)
    whole, ends = data.tobytes(), offsets.tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def sized_batches(batches: Iterable[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` text bytes at most, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = flat(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def per_text(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the per-byte values of each text."""
    running = np.concatenate([[0], np.cumsum(sums, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in a span [start, end)."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:size]) > 0


def qualified(spark: SparkSession, path: str) -> str:
    """`path` as a URI with the scheme that Spark takes it to have, for files that tasks write."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toUri().toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and "://" not in whole else whole


def resident(name: str, make: Callable[[], Any]) -> Any:
    """What `make` returns, kept for later tasks of the same Python worker.

    Only for tables derived from `name` alone, of bounded size.
    """
    store = sys.modules.setdefault("pipekit_resident", ModuleType("pipekit_resident")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def chosen(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's names; other columns cannot clash with its own."""
    return df.select(*[named(source).alias(name) for name, source in columns.items()])


def extended(df: DataFrame, columns: list[str], ddl: str) -> T.StructType:
    """The schema of some columns of `df` and further ones; names may hold any characters."""
    return T.StructType([*[df.schema[c] for c in columns], *T.StructType.fromDDL(ddl).fields])
