"""Cleaning: filters, duplicates, nulls, text, batch columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from pipekit.functions.text import TEXT_OPS, strip, title_case
from pipekit.operators.digests import distinct_count, repeats, without_copies
from pipekit.operators.keys import hashable, named, require

# Columns the default job title-cases, and its text for missing values.
STANDARD_COLUMNS = ("email", "city", "department")
UNKNOWN = "Unknown"


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.filter(condition)


def deduplicate(df: DataFrame, keys: Sequence[str], ts_col: str | None = None, keep: str = "last") -> DataFrame:
    """One row per key: the one with the latest (`last`) or earliest (`first`) `ts_col`.

    Ties, and the whole order when there is no `ts_col`, are settled by the remaining columns.
    A null `ts_col` loses either way. Spark cuts each map task's rows to the first of each key
    before the shuffle, however often a key occurs.
    """
    return _first_of_key(df, keys, ts_col, keep).filter("__n = 1").drop("__n")


def _first_of_key(df: DataFrame, keys: Sequence[str], ts_col: str | None, keep: str) -> DataFrame:
    """The rows with their place `__n` among those of their key."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    if not keys:
        raise ValueError("deduplicate needs at least one key column; see drop_duplicates")
    require(df, [*keys, *([ts_col] if ts_col else [])])
    types = {f.name: f.dataType for f in df.schema}
    rest = [c for c in df.columns if c not in keys and hashable(types[c])]
    ordered = [named(c) for c in ([ts_col] if ts_col in rest else []) + [c for c in rest if c != ts_col]]
    if ts_col in rest:
        ordered.insert(0, named(ts_col).isNull() if keep == "first" else named(ts_col).isNotNull())
    ordered = ordered or [F.lit(1)]
    window = Window.partitionBy(*[named(k) for k in keys]).orderBy(
        *[c.desc() if keep == "last" else c.asc() for c in ordered]
    )
    return df.withColumn("__n", F.row_number().over(window))


def deduplicate_counted(
    df: DataFrame, keys: Sequence[str], ts_col: str | None = None, keep: str = "last"
) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """`deduplicate`, and a function that tells `input_rows`, `kept` and `removed` once the rows
    have been used in an action. The rows are counted as they pass, in the same job."""
    before, after = Observation(), Observation()
    counted = df.observe(before, F.count(F.lit(1)).alias("n"))
    rows = deduplicate(counted, keys, ts_col, keep).observe(after, F.count(F.lit(1)).alias("n"))

    def counts() -> dict[str, int]:
        total, kept = before.get["n"], after.get["n"]
        return {"input_rows": total, "kept": kept, "removed": total - kept}

    return rows, counts


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None, by_digest: bool = False) -> DataFrame:
    """Remove rows that repeat another one in all columns (or keep any one row per `columns`).

    `by_digest` counts digests of the rows first, when this is called, so that only rows whose digest
    stands several times are shuffled: for wide tables with few copies.
    """
    require(df, columns or [])
    columns = list(columns) if columns else df.columns
    if not by_digest:
        return without_copies(df, columns)
    found = repeats(df, columns)
    return found.single.unionByName(without_copies(found.candidates, columns))


def duplicate_counts(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row `(input_rows, kept, removed)` for removing duplicates on `keys` (default: all).

    Wide rows are counted by their digests, when this is called, and compared in full only where a
    digest stands several times.
    """
    counts = distinct_count(df, list(keys) if keys else df.columns)
    return counts.withColumn("removed", F.col("input_rows") - F.col("kept"))


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of `columns` (default: all)."""
    return df.na.drop(how="any", subset=list(columns) if columns else None)


def _known(name: str, dtype: T.DataType) -> Column:
    """The column with NaN as null, as `na.drop` and `na.fill` see it."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(named(name)), named(name))
    return named(name)


def fill_nulls(df: DataFrame, value: Any, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls by `value`.

    Named columns all get it; a value of another type is cast to the column's type and an
    impossible cast is an error. Without names, the columns whose type the value fits are filled.
    """
    if value is None:
        raise ValueError("mode 'fill' needs a value")
    if not columns:
        return df.na.fill(value)
    require(df, columns)
    types = {f.name: f.dataType for f in df.schema}
    return df.withColumns(
        {c: F.coalesce(_known(c, types[c]), F.lit(value).cast(types[c])) for c in columns}
    )


def handle_nulls(df: DataFrame, strategy: Mapping[str, Any] | None = None) -> DataFrame:
    """`{"mode": "drop" | "fill", "value": ..., "columns": [...]}`; the default drops over all."""
    strategy = strategy or {"mode": "drop"}
    mode, columns = strategy.get("mode", "drop"), strategy.get("columns")
    if mode == "drop":
        return drop_nulls(df, columns)
    if mode == "fill":
        return fill_nulls(df, strategy.get("value"), columns)
    raise ValueError(f"null mode must be 'drop' or 'fill', not {mode!r}")


def fill_by_type(df: DataFrame) -> DataFrame:
    """Fill numeric columns with their mean and text columns with `Unknown`.

    NaN counts as missing, and other types keep their nulls. Integer columns become double,
    whether or not this table has nulls in them, so that the result's types follow from the
    schema. The means are one aggregate of one row, run together with the query.
    """
    types = {f.name: f.dataType for f in df.schema}
    numeric = [c for c, t in types.items() if isinstance(t, T.NumericType)]
    filled = {c: F.coalesce(named(c), F.lit(UNKNOWN)) for c, t in types.items() if isinstance(t, T.StringType)}
    if numeric:
        known = {c: _known(c, types[c]) for c in numeric}
        means = [F.avg(known[c]).cast("double").alias(f"m{i}") for i, c in enumerate(numeric)]
        found = df.agg(F.struct(*means).alias("means")).scalar()
        for i, c in enumerate(numeric):
            target = T.DoubleType() if isinstance(types[c], T.IntegralType) else types[c]
            filled[c] = F.coalesce(known[c].cast(target), found.getField(f"m{i}").cast(target))
    return df.withColumns(filled) if filled else df


def normalize_text(
    df: DataFrame, columns: Sequence[str], ops: Sequence[str] = ("trim", "lower", "rm_emoji")
) -> DataFrame:
    """Apply the named text operations to `columns`, in the order given."""
    unknown = [op for op in ops if op not in TEXT_OPS]
    if unknown:
        raise ValueError(f"unknown text operations {unknown}; known: {sorted(TEXT_OPS)}")
    require(df, columns)

    def apply(column: Column) -> Column:
        for op in ops:
            column = TEXT_OPS[op](column)
        return column

    return df.withColumns({c: apply(named(c)) for c in columns})


def standardize_text(df: DataFrame, columns: Sequence[str] = STANDARD_COLUMNS) -> DataFrame:
    """Strip and title-case the text columns whose lower-cased name is in `columns`."""
    wanted = {c.lower() for c in columns}
    hits = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name.lower() in wanted]
    return df.withColumns({c: title_case(strip(named(c))) for c in hits}) if hits else df


def add_batch_columns(df: DataFrame, batch_id: str) -> DataFrame:
    """Add the processing time and the batch's id."""
    return df.withColumns({"processed_at": F.current_timestamp(), "processing_batch_id": F.lit(batch_id)})


def empty_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn empty text into null, in `columns` or in every text column."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in text if c in columns] if columns else text
    return df.withColumns({c: F.nullif(named(c), F.lit("")) for c in chosen}) if chosen else df
