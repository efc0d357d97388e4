"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs: column names, row count, values. Empty if nothing does."""
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    ours, theirs = _rows(df.columns, df.collect()), _rows(names, relation.fetchall())
    found = []
    if ours.total() != theirs.total():
        found.append(f"rows {ours.total()} and {theirs.total()}")
    if ours != theirs:
        found.append(f"only ours {list((ours - theirs).items())[:3]}, only theirs {list((theirs - ours).items())[:3]}")
    return found
