"""Type names, locale-aware numbers and type guessing."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

# Accepted spellings of cast targets, lower case.
TYPE_ALIASES = {
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "float32": "float",
    "float64": "double",
    "string": "string",
    "object": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
}

# Fixed values: (thousands separators, decimal separator) by language.
SEPARATORS = {
    "en": (",", "."),
    "de": (".", ","),
    "es": (".", ","),
    "it": (".", ","),
    "pt": (".", ","),
    "nl": (".", ","),
    "fr": ("   ", ","),
    "ru": ("   ", ","),
}

# What counts as an integer, a number and a boolean in text.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_TEXT = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"
BOOLEAN_TEXT = ("true", "false")

INTEGRAL_TARGETS = ("tinyint", "smallint", "int", "bigint")
FRACTION_TARGET = re.compile(r"float|double|decimal.*")


def spark_type(name: str) -> str:
    """The Spark type for a cast target such as `Int64` or `Decimal(12,2)`."""
    lowered = name.strip().lower()
    return TYPE_ALIASES.get(lowered, lowered)


def plain_number(column: Column, locale: str, integral: bool = False) -> Column:
    """Rewrite a number written in `locale` to `1234.5` form; null if it is not one.

    What cannot be an integer is sorted out here as well, because a failing cast costs far more
    than a failing match.
    """
    language = locale.split("_")[0].lower()
    if language not in SEPARATORS:
        raise ValueError(f"unknown locale {locale!r}; known languages: {sorted(SEPARATORS)}")
    thousands, decimal = SEPARATORS[language]
    group, point = f"[{re.escape(thousands)}]", re.escape(decimal)
    text = F.trim(column)
    whole = rf"[0-9]{{1,3}}({group}[0-9]{{3}})+|[0-9]+"
    shape = rf"^[+-]?({whole})$"
    if not integral:
        shape = rf"^[+-]?({whole})?({point}[0-9]*)?([eE][+-]?[0-9]+)?$|(?i)^[+-]?(inf|infinity|nan)$"
    bare = F.translate(text, thousands + decimal, "".ljust(len(thousands)) + ".")
    return F.when(text.rlike(shape), F.replace(bare, F.lit(" "), F.lit("")))


def converted(column: Column, source: T.DataType, target: str, locale: str, strict: bool) -> Column:
    """`column` as `target`; values that do not fit become null, or an error when `strict`."""
    wanted = spark_type(target)
    integral = wanted in INTEGRAL_TARGETS
    if isinstance(source, T.StringType) and (integral or FRACTION_TARGET.fullmatch(wanted)):
        readable = plain_number(column, locale, integral)
        if strict:
            # An unreadable number must reach the cast, so that the cast can fail on it.
            readable = F.coalesce(readable, column)
        column = readable
    return column.cast(wanted) if strict else column.try_cast(wanted)


# The expressions below are SQL text: a profile has many per column, and one expression built
# from text costs the driver one call where a tree of columns costs dozens.


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def as_text(name: str, dtype: T.DataType) -> str:
    """A column as text, nested values as JSON."""
    column = quoted(name)
    if isinstance(dtype, T.StringType):
        return column
    return f"to_json({column})" if is_nested(dtype) else f"CAST({column} AS STRING)"


def present(name: str, dtype: T.DataType) -> str:
    """True where a value is present: not null, and for text not empty."""
    column = quoted(name)
    empty = f" AND {column} <> ''" if isinstance(dtype, T.StringType) else ""
    return f"({column} IS NOT NULL{empty})"


def guessed_type(name: str, dtype: T.DataType) -> str:
    """Aggregate: the narrowest of integer, number, boolean, string that fits every value.

    The pattern goes before the cast, because a failing cast costs far more than a failing match.
    """
    if isinstance(dtype, T.IntegralType):
        return "'integer'"
    if isinstance(dtype, T.NumericType):
        return "'number'"
    if isinstance(dtype, T.BooleanType):
        return "'boolean'"
    if not isinstance(dtype, T.StringType):
        return "'string'"
    column, some = quoted(name), f"FILTER (WHERE {present(name, dtype)})"
    return f"""CASE
        WHEN bool_and({column} RLIKE r'{INTEGER_TEXT}' AND try_cast({column} AS BIGINT) IS NOT NULL) {some}
            THEN 'integer'
        WHEN bool_and({column} RLIKE r'{NUMBER_TEXT}') {some} THEN 'number'
        WHEN bool_and(length({column}) <= 5 AND lower({column}) IN {BOOLEAN_TEXT}) {some} THEN 'boolean'
        ELSE 'string' END"""


# The Spark type each guess stands for.
GUESS_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string"}
