"""Repeated rows, found by digests.

To tell which rows repeat another one, 16 bytes of hash for each row are counted, map side first. Rows
whose digest stands alone repeat nothing, and only the others, usually few, are compared in full.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from pipekit.functions.types import as_text
from pipekit.operators.keys import group_keys, hashable, named
from pipekit.session import saved

# Digests that a broadcast may hold; more of them are joined by a shuffle.
MOST_BROADCAST = 500_000
# Rows of fixed-width columns up to so many bytes are no wider than their digest, and counted as they are.
NARROW = 32


class Repeats(NamedTuple):
    """`rows` and `distinct` digests of a table, of which `repeated` stand at several rows; the rows that
    have one of these, and those that have none."""

    rows: int
    distinct: int
    repeated: int
    candidates: DataFrame
    single: DataFrame


def digest(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Two hashes, equal for rows that are equal in `columns`, also in where nulls stand."""
    parts = []
    for name in columns:
        dtype = df.schema[name].dataType
        value = named(name) if hashable(dtype) else F.expr(as_text(name, dtype))
        parts += [named(name).isNull(), value]
    return {f"__digest{i}": F.xxhash64(F.lit(seed), *parts) for i, seed in enumerate((11, 29))}


def is_narrow(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether the columns of a row take no more room than a digest and its count."""
    kinds = [df.schema[c].dataType for c in columns]
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return all(isinstance(k, fixed) for k in kinds) and 8 * len(kinds) <= NARROW


def repeats(df: DataFrame, columns: Sequence[str]) -> Repeats:
    """Counts the digests, when called, and writes those of several rows to a small table."""
    names = list(digest(df, columns))
    tagged = df.withColumns(digest(df, columns))
    counted = tagged.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    seen = Observation()
    facts = [F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") > 1)]
    counted = counted.observe(seen, *[f.alias(name) for f, name in zip(facts, ("rows", "distinct", "repeated"))])
    several = saved(counted.where("n > 1").select(*names), "digests")
    found = seen.get
    if found["repeated"] <= MOST_BROADCAST:
        several = F.broadcast(several)
    candidates = tagged.join(several, names, "left_semi").drop(*names)
    single = tagged.join(several, names, "left_anti").drop(*names)
    return Repeats(found["rows"], found["distinct"], found["repeated"], candidates, single)


def distinct_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row `(input_rows, kept)`: all rows, and the different ones in `columns`."""
    if is_narrow(df, columns):
        groups = df.groupBy(*group_keys(df, columns)).agg(F.count(F.lit(1)).alias("n"))
        return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.count(F.lit(1)).alias("kept"))
    narrow = df.select(*[named(c) for c in columns])
    found = repeats(narrow, columns)
    alone = F.lit(found.distinct - found.repeated).cast("long")
    compared = found.candidates.groupBy(*group_keys(narrow, columns)).agg(F.lit(1).alias("one"))
    return compared.agg(
        F.lit(found.rows).cast("long").alias("input_rows"), (F.count(F.lit(1)) + alone).alias("kept")
    )


def without_copies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of each group of rows that are equal in `columns`; values that Spark cannot group count as JSON."""
    odd = {f"__key{i}": F.expr(as_text(c, df.schema[c].dataType)) for i, c in enumerate(columns) if not hashable(df.schema[c].dataType)}
    keys = [c for c in columns if hashable(df.schema[c].dataType)] + list(odd)
    return df.withColumns(odd).dropDuplicates(keys).drop(*odd) if odd else df.dropDuplicates(keys)
