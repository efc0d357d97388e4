"""Profiles merged from states against profiles of the whole."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pipekit.operators.carried import carried_profile, merge_states, profile_states
from pipekit.operators.quality import profile_columns

EXACT = ("column", "ordinal", "dtype", "row_count", "null_count", "null_percentage", "max_length", "avg_length")


def test_parts_merge_to_the_whole(spark, people):
    df = people.withColumn("m", F.expr("map('k', age)"))
    parts = [profile_states(df.where(c)) for c in ("id = 1", "id > 1", "id IS NULL", "id < 0")]
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    found = carried_profile(kept)
    assert rows(found, *EXACT) == rows(profile_columns(df, stats=EXACT[2:]), *EXACT)
    by = {r.column: r for r in found.collect()}
    assert by["age"].unique_count == 4 and by["email"].unique_count == 3
    assert by["age"].quantiles[1] in (30.0, 41.0) and by["email"].quantiles is None
    assert by["email"].frequent_values[0] == "ANNA@x.org"
    # Merged states are states: merged twice is merged once.
    again = carried_profile(merge_states(parts[0].unionByName(parts[1])).unionByName(merge_states(parts[2].unionByName(parts[3]))))
    assert rows(again, *EXACT, "unique_count") == rows(found, *EXACT, "unique_count")


def test_estimates_are_close(spark):
    df = spark.range(0, 50_000, 1, 5).selectExpr("id % 20000 AS a", "CAST(id AS double) / 7 AS b", "concat('t', id % 3) AS c")
    found = {r.column: r for r in carried_profile(profile_states(df)).collect()}
    assert found["a"].unique_count == pytest.approx(20_000, rel=0.05)
    assert found["b"].quantiles == pytest.approx([12_500 / 7, 25_000 / 7, 37_500 / 7], rel=0.05)
    assert sorted(found["c"].frequent_values) == ["t0", "t1", "t2"]


def test_states_of_nothing(spark, people):
    empty = {r.column: r for r in carried_profile(profile_states(people.limit(0))).collect()}
    assert list(empty) and all((r.row_count, r.unique_count, r.quantiles) == (0, 0, None) for r in empty.values())
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v double")
    assert carried_profile(profile_states(odd)).first().quantiles is None
