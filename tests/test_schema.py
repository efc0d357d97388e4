import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pipekit.operators import schema


def one(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"t {kind}")


GUESSES = [
    (["1", " 7 ", "-3", "+4", ""], "integer"),
    (["1", "1.5", ".5", "1e3", "nan", "-Inf"], "number"),
    (["1", str(2**70)], "number"),
    (["TRUE", "false", None], "boolean"),
    (["1", "true"], "string"),
    (["1_000"], "string"),
    (["1d"], "string"),
    (["0x1p3"], "string"),
    (["1", "x"], "string"),
    ([None, ""], "string"),
    ([], "string"),
    (["2024-01-01"], "string"),
]


@pytest.mark.parametrize("values, guess", GUESSES)
def test_guess(spark, values, guess):
    assert schema.guess_types(one(spark, values)).first().guessed_type == guess


def test_guess_of_typed_columns(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS d, 1.5 AS m, true AS b, date'2024-01-01' AS t, array(1) AS a, map(1, 2) AS p")
    assert [r.guessed_type for r in schema.guess_types(df).collect()] == [
        "integer", "number", "number", "boolean", "string", "string", "string",
    ]


def test_infer_schema(spark):
    df = spark.createDataFrame([("1", "a", 1.0), ("", "b", None)], "`odd.name` string, `it's` string, x double")
    assert [tuple(r) for r in schema.infer_schema(df).collect()] == [
        ("odd.name", 0, "bigint", True),
        ("it's", 1, "string", False),
        ("x", 2, "double", True),
    ]
    assert schema.infer_schema(df.limit(0)).count() == 3


CASTS = [
    ("Int64", "12", 12),
    ("Int64", "1.5", None),
    ("Int64", "-1,234,567", -1234567),
    ("Int64", " 42 ", 42),
    ("Int64", "1e3", None),
    ("Int64", "9" * 25, None),
    ("Decimal(9,2)", "1,234.567", decimal.Decimal("1234.57")),
    ("Float64", "-inf", float("-inf")),
    ("Int8", "300", None),
    ("Float64", "1,234.50", 1234.5),
    ("Float64", "12,34", None),
    ("Float64", "1e3", 1000.0),
    ("String", "x", "x"),
    ("Bool", "true", True),
    ("Date", "2024-02-30", None),
    ("Date", "2024-02-29", dt.date(2024, 2, 29)),
    ("DateTime", "2024-02-29 01:02:03", dt.datetime(2024, 2, 29, 1, 2, 3)),
    ("Int64", "junk", None),
    ("Int64", "", None),
    ("bigint", "5", 5),
]


@pytest.mark.parametrize("target, text, value", CASTS)
def test_cast(spark, target, text, value):
    assert schema.cast_types(one(spark, [text]), {"t": target}).first().t == value


@pytest.mark.parametrize(
    "locale, text, value",
    [
        ("de_DE", "1.234,50", 1234.5),
        ("de_DE", "-1.234.567,8", -1234567.8),
        ("de_DE", "1,234.50", None),
        ("fr_FR", "1 234,50", 1234.5),
        ("fr_FR", "1 234,50", 1234.5),
        ("ru_RU", "1 234,5", 1234.5),
        ("en_US", "1,234,567", 1234567.0),
        ("en_US", "1,2,3", None),
        ("en_US", " 7 ", 7.0),
        ("en_US", "-.5", -0.5),
        ("en_US", ".", None),
    ],
)
def test_cast_locale(spark, locale, text, value):
    assert schema.cast_types(one(spark, [text]), {"t": "Float64"}, locale).first().t == value


def test_cast_strict_and_failures(spark):
    df = one(spark, ["1", "x", None, "2"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schema.cast_types(df, {"t": "Int64"}, strict=True).collect()
    assert rows(schema.cast_types(df.filter("t <> 'x'"), {"t": "Int64"}, strict=True)) == [(1,), (2,)]
    assert [tuple(r) for r in schema.cast_failures(df, {"t": "Int64"}).collect()] == [("t", 0, "Int64", 1)]
    with pytest.raises(ValueError):
        schema.cast_types(df, {"t": "Int64"}, "tlh")
    with pytest.raises(ValueError):
        schema.cast_types(df, {"zz": "Int64"})


def at(*parts):
    return dt.datetime(*parts)


@pytest.mark.parametrize(
    "text, tz, unit, formats, value",
    [
        ("2024-03-10 23:59:59", "UTC", "day", [], at(2024, 3, 10)),
        ("2024-03-10T23:59:59", "UTC", "hour", [], at(2024, 3, 10, 23)),
        ("2024-03-10 07:30:00", "America/New_York", None, [], at(2024, 3, 10, 3, 30)),
        ("2024-03-10 06:30:00", "America/New_York", "hour", [], at(2024, 3, 10, 1)),
        ("2024-03-10T01:00:00+02:00", "UTC", None, [], at(2024, 3, 9, 23)),
        ("2024-03-10T01:00:00Z", "Asia/Tokyo", None, [], at(2024, 3, 10, 10)),
        ("2024-03-10", "UTC", None, [], at(2024, 3, 10)),
        ("bad", "UTC", None, [], None),
        ("10.03.2024 01:02", "UTC", None, ["dd.MM.yyyy HH:mm"], at(2024, 3, 10, 1, 2)),
        ("03/10/2024", "UTC", None, ["dd.MM.yyyy HH:mm", "MM/dd/yyyy"], at(2024, 3, 10)),
        ("2024-03-10 01:02 +0500", "UTC", None, ["yyyy-MM-dd HH:mm Z"], at(2024, 3, 9, 20, 2)),
        ("31/31/2024", "UTC", None, ["MM/dd/yyyy"], None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_time(spark, zone, text, tz, unit, formats, value):
    """The session's own time zone, with its missing hour that day, must not matter."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = schema.parse_time(one(spark, [text]), "t", tz, unit, formats=formats).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.t == value and row.t_cohort == (value and value.strftime("%Y-%m"))


def test_parse_time_of_instants(spark):
    df = spark.sql("SELECT timestamp_micros(1710054000123456) AS t")
    assert schema.parse_time(df, "t", add_cohort=False).first().t == at(2024, 3, 10, 7, 0, 0, 123456)


def test_cohort_is_taken_before_rounding_and_by_entity(spark):
    df = spark.createDataFrame(
        [(1, at(2024, 1, 31, 23)), (1, at(2024, 3, 1)), (None, at(2024, 5, 1)), (None, at(2024, 4, 1))],
        "u bigint, ts timestamp_ntz",
    )
    result = schema.parse_time(df, "ts", round_to="day", entity="u")
    assert rows(result, "ts_cohort") == [("2024-01",), ("2024-01",), ("2024-04",), ("2024-04",)]
    with pytest.raises(ValueError):
        schema.parse_time(df, "ts", round_to="week")


def test_names_with_dots(spark):
    df = spark.createDataFrame([("1", "2024-01-01")], "`a.b` string, `c.d` string")
    df = schema.parse_time(schema.cast_types(df, {"a.b": "Int64"}), "c.d")
    assert tuple(df.first()) == (1, at(2024, 1, 1), "2024-01")
    assert df.select(F.col("`c.d_cohort`")).count() == 1
