"""Database sink."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation

from pipekit.sinks.files import counted
from pipekit.sources.database import jdbc_options

WRITE_MODES = ("append", "overwrite")


def write_table(
    df: DataFrame,
    engine: str,
    table: str,
    url: str | None = None,
    mode: str = "append",
    batch_size: int = 50_000,
    connections: int = 16,
    options: Mapping[str, str] | None = None,
    seen: Observation | None = None,
) -> int:
    """Append to a database table, or replace its rows (`overwrite` keeps the table's definition).

    Returns the number of rows written.

    At most `connections` tasks write at once. Each task commits on its own, so a task that is
    lost after its commit and run again writes its rows twice: load into an empty staging table
    and check the count (`write_checked`) where that matters. `seen` gets the number of `rows`.
    """
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {list(WRITE_MODES)}, not {mode!r}")
    settings = {
        **jdbc_options(df.sparkSession, engine, url, options),
        "dbtable": table,
        "batchsize": str(batch_size),
        "numPartitions": str(connections),
    }
    if mode == "overwrite":
        settings["truncate"] = "true"
    seen = seen or Observation()
    # Spark would run the whole last stage in so few tasks; a shuffle leaves what comes before alone.
    spread = df.repartition(connections)
    counted(spread, seen).write.format("jdbc").options(**settings).mode(mode).save()
    return seen.get["rows"]
