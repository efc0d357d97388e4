"""Records of mixed JSON: types inferred over all of them, values that change type kept.

A field gets the one type that all its values fit; integers, decimals and doubles widen. A field that
is a number in one record and a text or an object in another one becomes a variant, in which every
value keeps its own type, at any depth. Text that is no JSON counts as `malformed` and has no value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pipekit.operators.keys import named, require

# Names of fields as the inferred type quotes them, and the words in it that are no type of a column.
_TYPE_WORDS = re.compile(r"`(?:[^`]|``)*`|\bOBJECT(?=<)|\bVOID\b(?!:)")


def _column_type(inferred: str) -> T.DataType:
    words = {"OBJECT": "STRUCT", "VOID": "VARIANT"}
    return T.DataType.fromDDL(_TYPE_WORDS.sub(lambda m: words.get(m[0], m[0]), inferred))


def json_schema(df: DataFrame, column: str) -> T.DataType:
    """The nested type of all records in a JSON text column, by one aggregate over all of them.

    Its size is that of all different fields together: for records whose field names are data, look at
    `json_kinds` and give a type by hand. Variant if the records are no objects of one kind, or none.
    """
    require(df, [column])
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(named(column)))).first()[0]
    return _column_type(found)


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """One row `(ordinal, field, type)` for each top field of the records, by name; none if they have no common type."""
    kind = json_schema(df, column)
    fields = kind.fields if isinstance(kind, T.StructType) else []
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, field string, type string")


def json_kinds(df: DataFrame, column: str) -> DataFrame:
    """One row `(field, kind, n)` for each top field and kind of its values, `void` for JSON's null.

    What is no object stands under field null. Counts are made map side first, and no list of
    fields is held in one place, so field names may be data.
    """
    require(df, [column])
    text = named(column)
    record = F.try_parse_json(text)
    rows = df.where(text.isNotNull()).select(record.alias("record"))
    rows = rows.withColumn("whole", F.schema_of_variant("record"))
    member = F.when(F.col("whole").startswith("OBJECT<"), F.col("record"))
    fields = rows.select("whole", member.alias("record")).lateralJoin(
        rows.sparkSession.tvf.variant_explode_outer(F.col("record").outer())
    )
    own = F.when(F.col("key").isNotNull(), F.schema_of_variant("value")).otherwise(F.col("whole"))
    kind = F.coalesce(F.lower(F.regexp_extract(own, "^[A-Z]+", 0)), F.lit("malformed"))
    return fields.groupBy(F.col("key").alias("field"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def parse_records(df: DataFrame, column: str, schema: T.DataType | None = None) -> DataFrame:
    """The JSON text of `column` as nested values of `schema`, by default that of all its records.

    Null where a record is malformed or does not fit a given schema. Read fields that changed their
    type with `variant_value`.
    """
    require(df, [column])
    kind = schema if schema is not None else json_schema(df, column)
    value = F.try_parse_json(named(column))
    return df.withColumn(column, value if isinstance(kind, T.VariantType) else value.try_cast(kind))


def variant_value(value: Column, kind: str, path: str = "$") -> Column:
    """What a variant holds at `path`, if it is of the kind `integer`, `number`, `boolean` or `string`, else null.

    Unlike a cast, it does not take the text "12" for a number, nor a number for a text.
    """
    # The type words that count as each kind, and the Spark type read.
    kinds = {
        "integer": ("BIGINT", "bigint"),
        "number": ("BIGINT|DECIMAL|DOUBLE|FLOAT", "double"),
        "boolean": ("BOOLEAN", "boolean"),
        "string": ("STRING", "string"),
    }
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}; known kinds: {sorted(kinds)}")
    words, target = kinds[kind]
    inner = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(inner).rlike(f"^({words})\\b"), F.try_variant_get(value, path, target))
