"""The default job: read, fill, de-duplicate, standardise, stamp, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pipekit.operators.clean import add_batch_columns, drop_duplicates, fill_by_type, standardize_text
from pipekit.sources.files import read_files, require_rows


def default_transform(df: DataFrame, batch_id: str) -> DataFrame:
    """Fill nulls by type, drop repeated rows, title-case the standard columns, add batch columns."""
    return add_batch_columns(standardize_text(drop_duplicates(fill_by_type(df))), batch_id)


def default_job(
    spark: SparkSession, path: str, batch_id: str, write: Callable[[DataFrame], None], **read_options
) -> DataFrame:
    """Read `path`, transform it in one plan and hand it to `write`; no rows is an error."""
    result = default_transform(require_rows(read_files(spark, path, **read_options)), batch_id)
    write(result)
    return result
