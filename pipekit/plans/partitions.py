"""Grids of time partitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pipekit.functions.times import local_clock, truncated
from pipekit.operators.keys import named

# Step units, and date letters with their Spark spelling.
UNITS = {"d": "day", "h": "hour"}
DATE_TOKENS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}

BLOCK = 1000  # steps that one row is exploded into


def _step(every: str) -> tuple[int, str]:
    found = re.fullmatch(r"(\d+)([dh])", every)
    if not found or int(found.group(1)) < 1:
        raise ValueError(f"every must look like '1d' or '1h', not {every!r}")
    return int(found.group(1)), UNITS[found.group(2)]


def _pattern(fmt: str) -> str:
    return re.sub("|".join(DATE_TOKENS), lambda token: DATE_TOKENS[token.group(0)], fmt)


def _starts(bounds: DataFrame, every: str) -> DataFrame:
    """Rows `starts_at` from `first` to `last` of the one row `bounds`.

    The steps come out of two short sequences, not out of one long array, and the second of them is
    made by as many tasks as the session shuffles to.
    """
    number, unit = _step(every)
    # Whole units from first to last: the last one counts only if its clock has come as far.
    units = F.date_diff(F.to_date("last"), F.to_date("first"))
    clock = "HHmmssSSSSSS"
    if unit == "hour":
        units, clock = units * 24 + F.hour("last") - F.hour("first"), "mmssSSSSSS"
    units = units - (F.date_format("last", clock) < F.date_format("first", clock)).cast("int")
    # Not below zero even where the filter comes later: a sequence must not run backwards.
    steps = F.greatest(F.floor(units / number), F.lit(0).cast("long"))
    steps = bounds.where("first <= last").select("first", steps.alias("steps"))
    blocks = steps.select("first", "steps", F.explode(F.sequence(F.lit(0).cast("long"), "steps", F.lit(BLOCK).cast("long"))).alias("block"))
    # A given number, as adaptive execution would join the few bytes of the blocks into one task.
    blocks = blocks.repartition(int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    last = F.least(F.col("block") + BLOCK - 1, F.col("steps"))
    each = blocks.select("first", F.explode(F.sequence("block", last)).alias("step"))
    past = (F.col("step") * number).cast("int")
    interval = F.make_dt_interval(hours=past) if unit == "hour" else F.make_dt_interval(days=past)
    return each.select((F.col("first") + interval).alias("starts_at"))


def _grid(bounds: DataFrame, every: str, fmt: str) -> DataFrame:
    """Rows `(partition, starts_at)` from `first` to `last` of the one row `bounds`."""
    return _starts(bounds, every).select(F.date_format("starts_at", _pattern(fmt)).alias("partition"), "starts_at")


def make_partitions(
    spark: SparkSession, start: str, end: str, every: str = "1d", tz: str = "UTC", fmt: str = "YYYY-MM-DD"
) -> DataFrame:
    """Rows `(partition, starts_at)` from `start` to `end` (included, may be `now`).

    Both are wall-clock times of `tz`, and so are the steps: a day is a calendar day.
    """

    def clock(text: str) -> Column:
        if text == "now":
            return F.convert_timezone(F.current_timezone(), F.lit(tz), F.localtimestamp())
        return F.lit(text).cast("timestamp_ntz")

    bounds = spark.range(1).select(clock(start).alias("first"), clock(end).alias("last"))
    return _grid(bounds, every, fmt)


def _clock(df: DataFrame, ts_col: str, unit: str, tz: str) -> Column:
    return truncated(local_clock(named(ts_col), df.schema[ts_col].dataType, tz), unit)


def partition_grid(
    df: DataFrame, ts_col: str, every: str = "1d", tz: str = "UTC", fmt: str = "YYYY-MM-DD"
) -> DataFrame:
    """Rows `(partition, starts_at)` that cover the times of a table, also where it has none."""
    clock = _clock(df, ts_col, _step(every)[1], tz)
    bounds = df.agg(F.min(clock).alias("first"), F.max(clock).alias("last"))
    return _grid(bounds, every, fmt)


def partition_counts(
    df: DataFrame, ts_col: str, every: str = "1d", tz: str = "UTC", fmt: str = "YYYY-MM-DD"
) -> DataFrame:
    """Rows `(partition, starts_at, rows)`: `partition_grid` with the table's rows per partition.

    Rows are counted per hour or day before the shuffle, and the steps are matched with the grid.
    """
    number, unit = _step(every)
    clock = _clock(df, ts_col, unit, tz)
    counts = df.groupBy(clock.alias("at")).agg(F.count(F.lit(1)).alias("n")).filter("at is not null")
    bounds = counts.agg(F.min("at").alias("first"), F.max("at").alias("last"))
    first = counts.agg(F.min("at")).scalar()
    units = F.date_diff(F.to_date("at"), F.to_date(first))
    if unit == "hour":
        units = units * 24 + F.hour("at") - F.hour(first)
    past = (F.floor(units / number) * number).cast("int")
    starts = first + (F.make_dt_interval(hours=past) if unit == "hour" else F.make_dt_interval(days=past))
    steps = counts.select(starts.alias("starts_at"), "n").groupBy("starts_at").agg(F.sum("n").alias("n"))
    rows = F.coalesce("n", F.lit(0).cast("long")).alias("rows")
    return _grid(bounds, every, fmt).join(steps, "starts_at", "left").select("partition", "starts_at", rows)
