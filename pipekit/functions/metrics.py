"""Aggregate functions by name."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, functions as F

from pipekit.functions.types import quoted

METRIC_OPS = {
    "sum": F.sum,
    "avg": F.avg,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count_distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct,
    "stddev": F.stddev,
    "var": F.variance,
    "median": F.median,
}


def metric(spec: Mapping[str, Any]) -> Column:
    """The aggregate for `{"op", "col"}`.

    `count` without a column counts rows. `first` and `last` take `order_by`, the column that
    says which value comes first; without it any non-null value may be returned.
    """
    op, name, order_by = spec["op"], spec.get("col"), spec.get("order_by")
    if op == "count":
        return F.count(F.lit(1) if name in (None, "*") else F.col(quoted(name)))
    if name is None:
        raise ValueError(f"metric op {op!r} needs a column")
    column = F.col(quoted(name))
    if op in ("first", "last"):
        if order_by is None:
            return (F.first if op == "first" else F.last)(column, ignorenulls=True)
        pick = F.min_by if op == "first" else F.max_by
        order = F.col(quoted(order_by))
        return pick(column, F.when(column.isNotNull() & order.isNotNull(), F.struct(order, column)))
    if op not in METRIC_OPS:
        raise ValueError(f"unknown metric op {op!r}; known: {sorted([*METRIC_OPS, 'count', 'first', 'last'])}")
    return METRIC_OPS[op](column)
