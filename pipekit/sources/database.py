"""Database sources: queries, whole tables and aggregates computed by the database."""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Driver class and quoting of the known engines.
DRIVERS = {"postgres": "org.postgresql.Driver", "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver"}
QUOTES = {"spark": "`", "postgres": '"', "clickhouse": "`"}

# SQL of the metric ops a database can compute.
SQL_METRICS = {
    "sum": "SUM({})",
    "avg": "AVG({})",
    "mean": "AVG({})",
    "min": "MIN({})",
    "max": "MAX({})",
    "count": "COUNT({})",
    "count_distinct": "COUNT(DISTINCT {})",
}

# A quoted text, or a `:name` that is not part of a `::cast`.
PARAMETER = re.compile(r"'(?:[^']|'')*'|(?<!:):([A-Za-z_]\w*)")


def jdbc_options(
    spark: SparkSession, engine: str, url: str | None = None, options: Mapping[str, str] | None = None
) -> dict[str, str]:
    """Options common to JDBC reads and writes.

    Without `url` the session must name one for the engine, in `spark.pipekit.<engine>.url`.
    """
    url = url or spark.conf.get(f"spark.pipekit.{engine}.url", None)
    if not url:
        raise ValueError(f"engine {engine!r} needs a JDBC url, given or in spark.pipekit.{engine}.url")
    driver = {"driver": DRIVERS[engine]} if engine in DRIVERS else {}
    return {"url": url, **driver, **(options or {})}


def sql_literal(value: Any) -> str:
    """A Python value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        if "\\" in value:
            raise ValueError("a text parameter may not hold a backslash: engines read it differently")
        return "'" + value.replace("'", "''") + "'"
    raise ValueError(f"cannot pass a {type(value).__name__} as a query parameter")


def bind(sql: str, params: Mapping[str, Any]) -> str:
    """Put `params` in place of their `:name` in `sql`; text in quotes is left alone."""

    def place(found: re.Match) -> str:
        name = found.group(1)
        if name is None:
            return found.group(0)
        if name not in params:
            raise ValueError(f"no value for the query parameter {name!r}")
        return sql_literal(params[name])

    return PARAMETER.sub(place, sql)


def read_query(
    spark: SparkSession,
    engine: str,
    sql: str,
    params: Mapping[str, Any] | None = None,
    url: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows of a query with named parameters (`:name`).

    Engine `spark` runs over registered views. Any other engine runs the query over JDBC on
    one connection; for a large table use `read_table` with bounds.
    """
    if engine == "spark":
        return spark.sql(sql, args=dict(params or {}))
    bound = bind(sql, params or {})
    return spark.read.format("jdbc").options(**jdbc_options(spark, engine, url, options), query=bound).load()


def read_table(
    spark: SparkSession,
    engine: str,
    table: str,
    url: str | None = None,
    column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 1,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A whole table; `column`, `bounds` and `partitions` split a JDBC read into ranges.

    Rows outside `bounds` are read too, by the first and last range.
    """
    if engine == "spark":
        return spark.table(table)
    settings = {**jdbc_options(spark, engine, url, options), "dbtable": table}
    if column:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        settings |= {
            "partitionColumn": column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**settings).load()


def aggregate_query(
    engine: str, table: str, group_by: Sequence[str], metrics: Mapping[str, Mapping[str, Any]]
) -> str:
    """The SQL of an aggregate, for `engine` to compute."""
    quote = QUOTES.get(engine, '"')

    def name(text: str) -> str:
        return quote + text.replace(quote, quote * 2) + quote

    def cell(alias: str, spec: Mapping[str, Any]) -> str:
        if spec["op"] not in SQL_METRICS:
            raise ValueError(f"{spec['op']!r} cannot be computed in the database; known: {sorted(SQL_METRICS)}")
        column = "*" if spec.get("col") in (None, "*") else name(spec["col"])
        return f"{SQL_METRICS[spec['op']].format(column)} AS {name(alias)}"

    groups = [name(g) for g in group_by]
    source = ".".join(name(part) for part in table.split("."))
    sql = f"SELECT {', '.join([*groups, *[cell(a, m) for a, m in metrics.items()]])} FROM {source}"
    return f"{sql} GROUP BY {', '.join(groups)}" if groups else sql


def aggregate_in_engine(
    spark: SparkSession,
    engine: str,
    table: str,
    group_by: Sequence[str],
    metrics: Mapping[str, Mapping[str, Any]],
    url: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Let the database group its own table, and read only the result."""
    return read_query(spark, engine, aggregate_query(engine, table, group_by, metrics), url=url, options=options)
