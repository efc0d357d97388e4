"""Profiles that are carried on: states of the parts of a table, kept as rows and merged.

A state is one row for each column, with counts and three sketches of bounded size: distinct values,
quantiles of numbers, frequent values of short text. States of different rows merge to the state of all
of them, so that a lake is profiled by reading each day once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from pipekit.functions.types import as_text, present, quoted, text_literal
from pipekit.operators.keys import column_rows, hashable

# Precision of the sketches: registers of distinct counts (a power of 2), frequent values followed.
REGISTERS, FOLLOWED = 14, 1_000
# Characters of a text that may be among the frequent values.
SHORT = 64


def profile_states(df: DataFrame) -> DataFrame:
    """One row per column, from one aggregate: `column, ordinal, dtype`, counts and sketches.

    Empty text counts as null, and nested values as JSON text, as in `profile_columns`; quantiles are of
    numbers that are not NaN.
    """
    facts = []
    for field in df.schema:
        name, dtype = field.name, field.dataType
        there, text = present(name, dtype), as_text(name, dtype)
        value = quoted(name) if hashable(dtype) else text
        number, length = "CAST(NULL AS DOUBLE)", "CAST(NULL AS INT)"
        if isinstance(dtype, T.NumericType):
            number = f"nullif(CAST({quoted(name)} AS DOUBLE), CAST('NaN' AS DOUBLE))"
        if isinstance(dtype, T.StringType):
            length = f"length({text})"
        facts.append(
            {
                "dtype": text_literal(dtype.simpleString()),
                "rows": "count(1)",
                "known": f"count_if({there})",
                "longest": f"max({length})",
                "characters": f"sum(CASE WHEN {there} THEN {length} END)",
                "distinct_values": f"hll_sketch_agg(CASE WHEN {there} THEN xxhash64({value}) END, {REGISTERS})",
                "quantiles": f"kll_sketch_agg_double({number})",
                "frequent": f"approx_top_k_accumulate(CASE WHEN {there} AND length({text}) <= {SHORT} THEN {text} END, {FOLLOWED})",
            }
        )
    return column_rows(df, df.schema.fields, facts)


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column from those of several parts; a column of two types is two columns."""
    return states.groupBy("column", "ordinal", "dtype").agg(
        F.sum("rows").alias("rows"),
        F.sum("known").alias("known"),
        F.max("longest").alias("longest"),
        F.sum("characters").alias("characters"),
        F.expr("hll_union_agg(distinct_values)").alias("distinct_values"),
        F.expr("kll_merge_agg_double(quantiles)").alias("quantiles"),
        F.expr(f"approx_top_k_combine(frequent, {FOLLOWED})").alias("frequent"),
    )


def carried_profile(states: DataFrame, at: Sequence[float] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """What merged states say: `column, ordinal, dtype, row_count, null_count, null_percentage,
    unique_count, max_length, avg_length, quantiles, frequent_values`.

    Counts and lengths are exact, the other three are estimates; quantiles of what is no number are null.
    """
    ranks = ", ".join(f"kll_sketch_get_quantile_double(quantiles, {float(q)}D)" for q in at)
    found = {
        "row_count": "rows",
        "null_count": "rows - known",
        "null_percentage": "coalesce(round(100 * try_divide(rows - known, rows), 2), 0D)",
        "unique_count": "hll_sketch_estimate(distinct_values)",
        "max_length": "longest",
        "avg_length": "try_divide(characters, known)",
        "quantiles": f"CASE WHEN kll_sketch_get_n_double(quantiles) > 0 THEN array({ranks}) END",
        "frequent_values": f"transform(approx_top_k_estimate(frequent, {top}), x -> x.item)",
    }
    return merge_states(states).select(
        "column", "ordinal", "dtype", *[F.expr(sql).alias(name) for name, sql in found.items()]
    )
