"""Data-quality profiles: one row per column, one row per table, and rule findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pipekit.functions.types import as_text, guessed_type, is_nested, present, quoted, text_literal
from pipekit.operators.clean import duplicate_counts
from pipekit.operators.keys import column_rows, hashable
from pipekit.operators.ordering import sample_rows

STATS = (
    "dtype",
    "guessed_type",
    "row_count",
    "null_count",
    "null_percentage",
    "unique_count",
    "max_length",
    "avg_length",
    "sample_values",
)

# Parts that the values of a column are dealt to by hash; each offers its least value as a sample.
SAMPLE_PARTS = 8

# Default limits for `quality_issues`.
DEFAULT_LIMITS = {"null_percentage": 20.0, "duplicate_percentage": 0.0, "max_length": 10_000.0}


def profile_columns(
    df: DataFrame,
    sample: int | None = None,
    exact_distinct: bool = False,
    sample_values: int = 5,
    stats: Sequence[str] = STATS,
) -> DataFrame:
    """One row per column: `column`, `ordinal` and the chosen `stats`, from one aggregate.

    Empty text counts as null, and nested values are profiled as JSON text. Lengths are for
    text only. `unique_count` is approximate unless `exact_distinct`, which shuffles the values
    of every column. `sample` profiles a random sample of so many rows instead of all. `sample_values` are up
    to so many different values of the whole column, sorted; there is one if there is any value.
    """
    unknown = [s for s in stats if s not in STATS]
    if unknown:
        raise ValueError(f"unknown stats {unknown}; known: {list(STATS)}")
    source = df if sample is None else sample_rows(df, sample)
    facts = []
    for i, field in enumerate(df.schema):
        known = _stats(field, i, exact_distinct, sample_values)
        facts.append({name: known[name] for name in stats})
    return column_rows(_dealt(source, stats), df.schema.fields, facts)


def _dealt(df: DataFrame, stats: Sequence[str]) -> DataFrame:
    """With the part that each value is dealt to, where samples are wanted."""
    if "sample_values" not in stats:
        return df
    parts = {}
    for i, field in enumerate(df.schema):
        value = quoted(field.name) if hashable(field.dataType) else as_text(field.name, field.dataType)
        dealt = f"CASE WHEN {present(field.name, field.dataType)} THEN pmod(xxhash64({value}), {SAMPLE_PARTS}) END"
        parts[f"__part{i}"] = F.expr(dealt)
    return df.withColumns(parts)


def _stats(field: T.StructField, ordinal: int, exact_distinct: bool, sample_values: int) -> dict[str, str]:
    """Aggregates by name, over the rows of `_dealt`."""
    name, dtype = field.name, field.dataType
    there, text = present(name, dtype), as_text(name, dtype)
    value = quoted(name) if hashable(dtype) else text
    is_text = isinstance(dtype, T.StringType)
    longest = f"max(length({text})) FILTER (WHERE {there})" if is_text else "CAST(NULL AS INT)"
    rows, some = "count(1)", f"count_if({there})"
    average = f"avg(length({text})) FILTER (WHERE {there})" if is_text else "CAST(NULL AS DOUBLE)"
    distinct = "count(DISTINCT {})" if exact_distinct else "approx_count_distinct({})"
    # The least value of each part; what is no nested value becomes text only afterwards.
    plain = hashable(dtype) and not is_nested(dtype)
    least = f"min(if(__part{ordinal} = {{}}, {quoted(name) if plain else text}, NULL))"
    samples = ", ".join(f"CAST({least.format(i)} AS STRING)" for i in range(SAMPLE_PARTS))
    return {
        "dtype": text_literal(dtype.simpleString()),
        "guessed_type": guessed_type(name, dtype),
        "row_count": rows,
        "null_count": f"({rows} - {some})",
        "null_percentage": f"coalesce(round(100 * try_divide({rows} - {some}, {rows}), 2), 0D)",
        "unique_count": distinct.format(f"CASE WHEN {there} THEN {value} END"),
        "max_length": longest,
        "avg_length": average,
        "sample_values": f"slice(array_sort(array_compact(array({samples}))), 1, {sample_values})",
    }


def profile_table(df: DataFrame, sample: int | None = None, stats: Sequence[str] = STATS) -> DataFrame:
    """One row: the facts of `profile_dataset`, and `columns`, an array with those of
    `profile_columns`, from one pass, beside that over the digests of the rows."""
    source = df if sample is None else sample_rows(df, sample)
    structs = []
    for i, field in enumerate(df.schema):
        known = _stats(field, i, False, 5)
        facts = {"column": text_literal(field.name), "ordinal": str(i)} | {name: known[name] for name in stats}
        structs.append(F.expr("struct(" + ", ".join(f"{sql} AS {quoted(n)}" for n, sql in facts.items()) + ")"))
    return _dataset_facts(source, _dealt(source, stats), [F.array(*structs).alias("columns")])


def profile_dataset(df: DataFrame, sample: int | None = None) -> DataFrame:
    """One row: `row_count, column_count, total_nulls, duplicate_rows, completeness_score,
    quality_score, null_counts`.

    Completeness is `100 * (1 - nulls / cells)`, 100 for an empty table; the quality score is
    the same number. Repeated rows are counted by digest, when this is called; the rest is one pass.
    """
    source = df if sample is None else sample_rows(df, sample)
    return _dataset_facts(source, source, [])


def _dataset_facts(source: DataFrame, dealt: DataFrame, more: Sequence[Column]) -> DataFrame:
    schema = source.schema
    width, extra = len(schema), [F.col("columns")] * bool(more)
    nulls = [F.expr(f"count_if(NOT {present(f.name, f.dataType)})") for f in schema]
    facts = dealt.agg(F.count(F.lit(1)).alias("row_count"), F.array(*nulls).alias("nulls"), *more)
    facts = facts.withColumn("total_nulls", F.aggregate("nulls", F.lit(0).cast("bigint"), lambda total, n: total + n))
    cells = F.col("row_count") * width
    score = F.when(cells == 0, F.lit(100.0)).otherwise(100 * (1 - F.col("total_nulls") / cells))
    return facts.select(
        "row_count",
        F.lit(width).alias("column_count"),
        "total_nulls",
        duplicate_counts(source).select("removed").scalar().alias("duplicate_rows"),
        score.alias("completeness_score"),
        score.alias("quality_score"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in schema.names]), "nulls").alias("null_counts"),
        *extra,
    )


def quality_issues(df: DataFrame, limits: Mapping[str, float] | None = None) -> DataFrame:
    """Rows `(column, issue, value)`, one for each limit that is broken.

    Per column: `null_percentage` or `max_length` above its limit, and `constant` (one value,
    no nulls, more than one row). For the whole table, with a null `column`: the percentage of
    rows that repeat another one above `duplicate_percentage`.
    """
    limits = {**DEFAULT_LIMITS, **(limits or {})}
    stats = ("row_count", "null_count", "null_percentage", "unique_count", "max_length")
    constant = (F.col("unique_count") == 1) & (F.col("null_count") == 0) & (F.col("row_count") > 1)
    findings = F.array(
        _finding("null_percentage", F.col("null_percentage"), F.col("null_percentage") > limits["null_percentage"]),
        _finding("max_length", F.col("max_length"), F.col("max_length") > limits["max_length"]),
        _finding("constant", F.col("unique_count"), constant),
    )
    by_column = profile_columns(df, stats=stats).select("column", F.explode(F.array_compact(findings)).alias("f"))
    percentage = F.round(F.col("removed") * 100 / F.nullif(F.col("input_rows"), F.lit(0)), 2)
    copies = _finding("duplicate_percentage", percentage, percentage > limits["duplicate_percentage"])
    whole = duplicate_counts(df).select(F.lit(None).cast("string").alias("column"), copies.alias("f"))
    return by_column.unionByName(whole.filter("f is not null")).select("column", "f.issue", "f.value")


def _finding(issue: str, value: Column, broken: Column) -> Column:
    return F.when(broken, F.struct(F.lit(issue).alias("issue"), value.cast("double").alias("value")))
