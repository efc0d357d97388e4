"""Mixed JSON."""

import pytest
from pyspark.sql import functions as F, types as T

from conftest import rows
from pipekit.operators import variants

RECORDS = [
    '{"a b": 1, "m": 1, "o": {"x": 1}, "l": [1, 2], "n": null, "d": 1.5, "OBJECT<": true, "VOID": 1}',
    '{"a b": 2, "m": "t", "o": {"x": "q", "y": true}, "l": [1.5], "d": 2}',
    '{"m": {"z": 1}, "d": 1e300, "`": "VOID"}',
    '{"m": "12"}',
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, record string").repartition(3)


def test_nested_types(spark):
    kinds = {f.name: f.dataType.simpleString() for f in variants.json_schema(frame(spark, RECORDS), "record").fields}
    assert kinds == {
        "a b": "bigint", "m": "variant", "o": "struct<x:variant,y:boolean>", "l": "array<decimal(21,1)>", "n": "variant",
        "d": "double", "OBJECT<": "boolean", "VOID": "bigint", "`": "string",
    }


def test_values_keep_their_types(spark):
    parsed = variants.parse_records(frame(spark, [*RECORDS, "{", None]), "record")
    m = F.col("record")["m"]
    kept = parsed.select(
        "i",
        F.to_json(m).alias("json"),
        variants.variant_value(m, "integer").alias("whole"),
        variants.variant_value(m, "string").alias("text"),
        variants.variant_value(m, "number", "$.z").alias("z"),
        F.col("record")["a b"].alias("ab"),
    )
    assert rows(kept, "i", "json", "whole", "text", "z", "ab") == [
        (0, "1", 1, None, None, 1),
        (1, '"t"', None, "t", None, 2),
        (2, '{"z":1}', None, None, 1.0, None),
        (3, '"12"', None, "12", None, None),
        (4, None, None, None, None, None),
        (5, None, None, None, None, None),
    ]
    with pytest.raises(ValueError, match="known kinds"):
        variants.variant_value(m, "date")


def test_given_type(spark):
    kind = T.StructType.fromDDL("m bigint")
    parsed = variants.parse_records(frame(spark, ['{"m": 1}', '{"m": {"z": 1}}', "[1]", '{"q": 1}']), "record", kind)
    assert rows(parsed.select("i", "record.m"), "i", "m") == [(0, 1), (1, None), (2, None), (3, None)]


@pytest.mark.parametrize("texts", [[], [None], ["{"], ["1", '"a"'], ['{"a": 1}', "[1]"], ["null"]])
def test_no_common_type(spark, texts):
    df = frame(spark, texts)
    assert isinstance(variants.json_schema(df, "record"), T.VariantType)
    assert variants.json_fields(df, "record").count() == 0
    assert variants.parse_records(df, "record").count() == len(texts)


def test_kinds(spark):
    df = frame(spark, [*RECORDS, "{", None, "{}", "null", "[1]", '{"m": null}'])
    found = rows(variants.json_kinds(df, "record").where("field IS NULL OR field IN ('m', 'd')"), "field", "kind", "n")
    want = [
        ("d", "bigint", 1), ("d", "decimal", 1), ("d", "double", 1), ("m", "bigint", 1), ("m", "object", 1),
        ("m", "string", 2), ("m", "void", 1), (None, "array", 1), (None, "malformed", 1), (None, "object", 1), (None, "void", 1),
    ]
    assert sorted(found, key=str) == sorted(want, key=str)
