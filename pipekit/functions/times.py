"""Time expressions on wall-clock timestamps (`timestamp_ntz`)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

QUOTED = re.compile(r"'[^']*'")
ZONE_LETTER = re.compile(r"[XxZzVO]")
ZONED_TEXT = r":\d{2}(\.\d+)?\s*(Z|[+-]\d{1,2}(:?\d{2})?|[A-Z][A-Za-z]*(/\w+)*)\s*$"


def utc_clock(instant: Column) -> Column:
    """The UTC wall clock of a `timestamp`, whatever the session's time zone is."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def parsed(column: Column, dtype: T.DataType, formats: list[str]) -> Column:
    """`column` as a UTC wall clock.

    Text that fits none of `formats` (or, without formats, is not ISO) becomes null. Text
    without a zone is taken as UTC; text with one is moved to UTC.
    """
    if isinstance(dtype, T.TimestampType):
        return utc_clock(column)
    if not isinstance(dtype, T.StringType):
        return column.cast("timestamp_ntz")
    if not formats:
        zoned = utc_clock(F.when(column.rlike(ZONED_TEXT), column).try_cast("timestamp"))
        return F.coalesce(zoned, F.when(~column.rlike(ZONED_TEXT), column).try_cast("timestamp_ntz"))
    return F.coalesce(*[_read(column, fmt) for fmt in formats])


def _read(column: Column, fmt: str) -> Column:
    instant = F.try_to_timestamp(column, F.lit(fmt))
    if ZONE_LETTER.search(QUOTED.sub("", fmt)):
        return utc_clock(instant)
    return F.to_timestamp_ntz(F.when(instant.isNotNull(), column), F.lit(fmt))


def local_clock(column: Column, dtype: T.DataType, tz: str, formats: Sequence[str] = ()) -> Column:
    """`column` as the wall clock of `tz`."""
    clock = parsed(column, dtype, list(formats))
    return clock if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), clock)


def truncated(column: Column, unit: str | None) -> Column:
    """Cut to the hour or day without passing through a time zone."""
    if unit is None:
        return column
    day = F.to_date(column).cast("timestamp_ntz")
    if unit == "day":
        return day
    if unit == "hour":
        return day + F.make_dt_interval(hours=F.hour(column))
    raise ValueError(f"round_to must be 'hour', 'day' or None, not {unit!r}")


def month(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")
