"""A first look at a file: its size, types, missing values and quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pipekit.operators.quality import STATS, profile_table
from pipekit.session import saved
from pipekit.sources.files import read_files


def analyze_file(
    spark: SparkSession,
    path: str,
    fmt: str = "auto",
    sample: int | None = None,
    stats: Sequence[str] = tuple(s for s in STATS if s != "dtype"),
    **read_options,
) -> tuple[DataFrame, DataFrame]:
    """The one-row profile of a file, and one row per column with the chosen `stats`.

    Columns are read as text, so that types are guessed from what the file says. Both come from
    one pass, made when this is called. `sample` looks at any so many rows only.
    """
    df = read_files(spark, path, fmt=fmt, infer=False, **read_options)
    found = saved(profile_table(df, sample, stats), "profile")
    return found.drop("columns"), found.select(F.inline("columns"))
