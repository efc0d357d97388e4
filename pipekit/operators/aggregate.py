"""Group aggregates and pivots."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from pipekit.functions.metrics import metric
from pipekit.functions.order import has_order_key
from pipekit.operators.keys import largest_group, match, named, require
from pipekit.operators.ordering import rank_rows
from pipekit.operators.selection import at_ranks

Metrics = Mapping[str, Mapping[str, Any]]


def aggregate(
    df: DataFrame,
    group_by: Sequence[str] = (),
    metrics: Metrics = {},
    max_group_rows: int | None = None,
) -> DataFrame:
    """One row per group (or one in all) with `metrics = {name: {"op", "col"}}`.

    Null group keys form a group. All metrics but `median` keep a fixed-size state per group
    and are combined before the shuffle (`count_distinct` after removing duplicates). An exact
    median must see every value of its group. Where groups may be very large, `max_group_rows`
    asks to count them first, in a job of its own; if one has more rows, medians are found by
    counting rows by their leading bits, in three passes, with the same result and type.
    """
    if not metrics:
        raise ValueError("aggregate needs at least one metric")
    require(df, [*group_by, *[m["col"] for m in metrics.values() if m.get("col") not in (None, "*")]])
    groups = [named(g) for g in group_by]
    medians = {name: m["col"] for name, m in metrics.items() if m["op"] == "median"}
    if not medians or max_group_rows is None or largest_group(df, group_by) <= max_group_rows:
        return df.groupBy(*groups).agg(*[metric(m).alias(name) for name, m in metrics.items()])

    others = [metric(m).alias(name) for name, m in metrics.items() if name not in medians]
    result = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows"), *others)
    for name, column in medians.items():
        result = _with_spread_median(result, df, list(group_by), column, name)
    return result.select(*groups, *[named(name) for name in metrics])


def _with_spread_median(result: DataFrame, df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Add to the aggregate `result` the mean of the one or two middle values of each group."""
    groups = [named(k) for k in keys]
    kind = df.select(F.median(named(column)).alias("m")).schema["m"].dataType
    if has_order_key(df.schema[column].dataType):
        middle = F.array_distinct(F.expr("array((__n + 1) div 2, __n div 2 + 1)"))
        values = at_ranks(df, keys, column, middle).withColumn("value", F.col("value").cast("double"))
        mean = F.expr("if(count(1) = 1, min(value), sum(0.5D * value))")  # as Spark's median does it
    else:  # numbers of more than 64 bits
        known = df.select(*groups, named(column).alias("__value")).filter("__value is not null")
        places = rank_rows(known, ["__value"], keys, rank_col="__place", max_group_rows=0)
        counts = places.groupBy(*groups).agg(F.max("__place").alias("__n"))
        sized = match(places, counts, keys) if keys else places.withColumn("__n", counts.scalar())
        values = sized.filter(F.col("__place").between(F.expr("(__n + 1) div 2"), F.expr("__n div 2 + 1")))
        mean = F.avg("__value")
    medians = values.groupBy(*groups).agg(mean.cast(kind).alias(name))
    return match(result, medians, keys, "left_outer") if keys else result.withColumn(name, medians.scalar())


def pivot(
    df: DataFrame,
    index: Sequence[str],
    columns: Sequence[str],
    values: Sequence[str],
    aggfunc: str = "sum",
    fill_value: Any = None,
    pivot_values: Sequence[Any] | None = None,
) -> DataFrame:
    """One row per `index`, one column per value of `columns` (joined by `_` if several).

    With several `values` the columns are named `<pivot>_<value>`; a null is called `null`. Cells
    are told apart by the values themselves, and two that would get one name are an error.
    Without `pivot_values` (for several `columns`, sequences of values) a first job finds them;
    more than `spark.sql.pivotMaxValues` of them is an error. Cells are aggregated by index and
    pivot value before the shuffle, then laid out side by side.
    """
    if not (index and columns and values):
        raise ValueError("pivot needs index, columns and values")
    require(df, [*index, *columns, *values])
    several = len(columns) > 1
    key = F.concat_ws("_", *[_escaped(c) for c in columns]) if several else named(columns[0])
    wanted = list(pivot_values) if pivot_values is not None else None
    if several and wanted is not None:
        if any(isinstance(v, str) or len(v) != len(columns) for v in wanted):
            raise ValueError(f"pivot_values must be sequences of {len(columns)} values")
        wanted = ["_".join(NULL if x is None else _escape(str(x)) for x in v) for v in wanted]
    cells = [metric({"op": aggfunc, "col": v}).alias(v) for v in values]
    result = df.withColumn("__pivot", key).groupBy(*[named(i) for i in index]).pivot("__pivot", wanted).agg(*cells)
    cell_types = list(result.schema)[len(index) :]
    names = [_unescape(f.name) if several else f.name for f in cell_types]
    taken = [*index, *names]
    clashing = sorted({n for n in taken if taken.count(n) > 1})
    if clashing:
        raise ValueError(f"different values of {list(columns)} give columns of the same name: {clashing}")
    result = result.toDF(*taken)
    if fill_value is None:
        return result
    return result.withColumns(
        {n: F.coalesce(named(n), F.lit(fill_value).cast(f.dataType)) for n, f in zip(names, cell_types)}
    )


# How one of several pivot values is written into a key: `\` and `_` are escaped, and null is `\0`.
NULL = "\\0"


def _escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("_", "\\_")


def _escaped(name: str) -> Column:
    text = F.replace(named(name).cast("string"), F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(F.replace(text, F.lit("_"), F.lit("\\_")), F.lit(NULL))


def _unescape(key: str) -> str:
    return re.sub(r"\\(.)", lambda found: "null" if found[1] == "0" else found[1], key)
