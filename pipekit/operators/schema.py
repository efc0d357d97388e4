"""Schema inference, casts and time columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from pipekit.functions.times import local_clock, month, truncated
from pipekit.functions.types import GUESS_TYPES, converted, guessed_type, present, quoted, text_literal
from pipekit.operators import ordering
from pipekit.operators.keys import column_rows, match, named, require


def guess_types(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """One row `(column, ordinal, guessed_type)` per column.

    A text column is the narrowest of integer, number, boolean and string that fits all its
    non-empty values; one aggregate covers every column. `sample_rows` looks at a random sample
    of so many rows only.
    """
    source = df if sample_rows is None else ordering.sample_rows(df, sample_rows)
    facts = [{"guessed_type": guessed_type(f.name, f.dataType)} for f in df.schema]
    return column_rows(source, df.schema.fields, facts)


def infer_schema(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """One row `(column, ordinal, type, nullable)` per column.

    Text columns get the Spark type their values allow, others keep theirs; `nullable` says
    whether a value is missing (null or empty).
    """
    source = df if sample_rows is None else ordering.sample_rows(df, sample_rows)
    named_types = ", ".join(f"'{guess}', '{name}'" for guess, name in GUESS_TYPES.items())
    facts = []
    for f in df.schema:
        kind = text_literal(f.dataType.simpleString())
        if isinstance(f.dataType, T.StringType):
            kind = f"map({named_types})[{guessed_type(f.name, f.dataType)}]"
        missing = f"coalesce(bool_or(NOT {present(f.name, f.dataType)}), false)"
        facts.append({"type": kind, "nullable": missing})
    return column_rows(source, df.schema.fields, facts)


def cast_types(
    df: DataFrame, casts: Mapping[str, str], locale: str = "en_US", strict: bool = False
) -> DataFrame:
    """Cast the columns of `casts = {column: type}`.

    Types go by Spark's names or aliases such as `Int64`. Text is read as a number of `locale`.
    Values that do not fit become null (`cast_failures` counts them) or, if `strict`, an error.
    """
    require(df, list(casts))
    types = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: converted(named(c), types[c], t, locale, strict) for c, t in casts.items()})


def cast_failures(df: DataFrame, casts: Mapping[str, str], locale: str = "en_US") -> DataFrame:
    """One row `(column, ordinal, target, failures)` per cast: the values it would turn to null."""
    require(df, list(casts))
    fields = [df.schema[c] for c in casts]
    trials = df.withColumns(
        {f"__cast{i}": converted(named(f.name), f.dataType, casts[f.name], locale, False) for i, f in enumerate(fields)}
    )
    facts = [
        {
            "target": text_literal(casts[f.name]),
            "failures": f"count_if({quoted(f.name)} IS NOT NULL AND __cast{i} IS NULL)",
        }
        for i, f in enumerate(fields)
    ]
    return column_rows(trials, fields, facts)


def parse_time(
    df: DataFrame,
    col: str,
    tz: str = "UTC",
    round_to: str | None = None,
    add_cohort: bool = True,
    formats: Sequence[str] = (),
    entity: str | None = None,
) -> DataFrame:
    """Parse `col`, move it to the wall clock of `tz`, cut it, and add `<col>_cohort`.

    Text without a zone is UTC; the result is `timestamp_ntz`. The cohort is the month, or with
    `entity` the month of the entity's first time; that minimum is aggregated and joined back,
    so an entity with very many rows is never gathered in one task.
    """
    require(df, [col, *([entity] if entity else [])])
    result = df.withColumn(col, local_clock(named(col), df.schema[col].dataType, tz, formats))
    if add_cohort and entity:
        firsts = result.groupBy(named(entity)).agg(month(F.min(named(col))).alias(f"{col}_cohort"))
        result = match(result, firsts, [entity], "left_outer")
    elif add_cohort:
        result = result.withColumn(f"{col}_cohort", month(named(col)))
    return result.withColumn(col, truncated(named(col), round_to))
