"""The query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pipekit.session import tune

Tables = Callable[[str], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register a function of `table(name)`; `sql` is the same query for the oracle."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        if name in QUERIES:
            raise ValueError(f"two queries are called {name!r}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
