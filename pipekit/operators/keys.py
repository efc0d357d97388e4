"""Helpers for key columns: null-safe matching and the size of the largest key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pipekit.functions.types import as_text, quoted, text_literal

# Rows that may be gathered in one task because a caller asked for so many.
GATHERED_ROWS = 1_000_000


def named(name: str) -> Column:
    """Column reference that also works for names with dots."""
    return F.col(quoted(name))


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}; have {df.columns}")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """Any `n` rows, gathered in one task; more than `GATHERED_ROWS` is an error."""
    if n > GATHERED_ROWS:
        raise ValueError(f"{n} rows are too many for one task; take a fraction with `sample`")
    return df.limit(n)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key (of the whole table without keys).

    Reads only the key columns, counts before the shuffle and returns one number.
    """
    counts = df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def match(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join `other` to `df`; null keys match each other."""
    renamed = other.withColumnsRenamed({k: f"__match_{k}" for k in keys})
    pairs = [named(k).eqNullSafe(named(f"__match_{k}")) for k in keys]
    joined = df.join(renamed, reduce(Column.__and__, pairs), how)
    return joined.drop(*[f"__match_{k}" for k in keys])


def hashable(dtype: T.DataType) -> bool:
    """Whether Spark can hash, compare and group values of this type."""
    if isinstance(dtype, T.ArrayType):
        return hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(hashable(f.dataType) for f in dtype)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def group_keys(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns in a form that can be grouped by: maps as JSON text."""
    fields = [df.schema[c] for c in columns]
    return [named(f.name) if hashable(f.dataType) else F.expr(as_text(f.name, f.dataType)).alias(f.name) for f in fields]


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, for a repeatable order among rows with equal keys."""
    names = [f.name for f in df.schema if hashable(f.dataType)]
    return F.xxhash64(*[named(n) for n in names] or [F.lit(None)])


def column_rows(df: DataFrame, fields: Sequence[T.StructField], facts: Sequence[Mapping[str, str]]) -> DataFrame:
    """One row per field, `column`, `ordinal` and its `facts`, from one aggregate over `df`.

    The facts are SQL aggregates by name, the same names for every field.
    """
    if not fields:
        raise ValueError("there are no columns to look at")
    structs = []
    for i, (field, named_facts) in enumerate(zip(fields, facts)):
        items = ", ".join(f"{sql} AS {quoted(name)}" for name, sql in named_facts.items())
        structs.append(F.expr(f"struct({items})").alias(f"c{i}"))
    rows = ", ".join(f"struct({text_literal(f.name)} AS column, {i} AS ordinal, c{i}.*)" for i, f in enumerate(fields))
    return df.agg(*structs).select(F.expr(f"inline(array({rows}))"))
