import pytest
from pyspark.sql import functions as F

from conftest import final_plan, plan, rows
from pipekit.operators import digests, quality
from pipekit.operators.clean import drop_duplicates, duplicate_counts
from pipekit.operators.quality import profile_columns, profile_dataset, quality_issues


def by_name(profile):
    return {r.column: r for r in profile.collect()}


def test_profile_columns(people):
    found = by_name(profile_columns(people, exact_distinct=True))
    assert list(found) == people.columns
    email, age, salary = found["email"], found["age"], found["salary"]
    assert (email.row_count, email.null_count, email.null_percentage, email.unique_count) == (6, 2, 33.33, 3)
    assert (email.max_length, email.avg_length) == (10, (10 + 10 + 9 + 7) / 4)
    assert email.sample_values == sorted(email.sample_values) and set(email.sample_values) <= {
        "ANNA@x.org", "bob@y.org", "c@z.org",
    }
    assert (age.dtype, age.guessed_type, age.max_length, age.unique_count) == ("bigint", "integer", None, 4)
    assert (salary.dtype, salary.guessed_type, salary.null_count) == ("double", "number", 1)


def test_nulls_are_what_a_filter_finds(people):
    for name, row in by_name(profile_columns(people, stats=["null_count"])).items():
        missing = F.col(name).isNull()
        if dict(people.dtypes)[name] == "string":
            missing = missing | (F.col(name) == "")
        assert row.null_count == people.filter(missing).count()


def test_empty_table(people):
    none = people.limit(0)
    for row in profile_columns(none).collect():
        assert (row.row_count, row.null_count, row.null_percentage, row.unique_count) == (0, 0, 0.0, 0)
        assert row.sample_values == [] and row.avg_length is None
    facts = profile_dataset(none).first()
    assert (facts.row_count, facts.duplicate_rows, facts.total_nulls) == (0, 0, 0)
    assert facts.completeness_score == facts.quality_score == 100.0
    assert quality_issues(none).isEmpty()


def test_profile_dataset(people):
    facts = profile_dataset(people).first()
    assert (facts.row_count, facts.column_count, facts.duplicate_rows, facts.total_nulls) == (6, 6, 1, 7)
    assert facts.completeness_score == pytest.approx(100 * (1 - 7 / 36))
    assert facts.null_counts == {"id": 1, "email": 2, "city": 1, "department": 1, "salary": 1, "age": 1}


def test_nested_values(spark):
    df = spark.sql(
        "SELECT array(id) AS a, named_struct('x', id) AS s, map('k', id % 2) AS m, CAST(id AS decimal(9,2)) AS d, "
        "id % 2 = 0 AS b, date_add(date'2024-01-01', CAST(id AS int)) AS t FROM range(4)"
    )
    found = by_name(profile_columns(df, exact_distinct=True))
    assert [found[c].unique_count for c in "asmdbt"] == [4, 4, 2, 4, 2, 4]
    assert set(found["m"].sample_values) <= {'{"k":0}', '{"k":1}'} and found["m"].sample_values
    assert set(found["b"].sample_values) <= {"true", "false"} and found["b"].sample_values
    assert profile_dataset(df.drop("a", "s", "d", "b", "t")).first().duplicate_rows == 2


def test_samples_are_values_of_the_column(table):
    lines = table("lineitem")
    for row in profile_columns(lines, stats=["sample_values"], sample_values=4).collect():
        values = {r[0] for r in lines.select(F.col(row.column).cast("string")).distinct().collect()}
        assert 1 <= len(row.sample_values) <= 4 and set(row.sample_values) <= values


def test_sample_and_choice_of_stats(table):
    profile = profile_columns(table("events"), sample=100, stats=["row_count"])
    assert profile.columns == ["column", "ordinal", "row_count"] and {r.row_count for r in profile.collect()} == {100}
    with pytest.raises(ValueError):
        profile_columns(table("events"), stats=["mode"])


def test_one_pass(table):
    """One scan and one shuffle of one row per task, whatever the number of columns."""
    text = final_plan(profile_columns(table("lineitem")))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "SinglePartition" in text


def test_only_repeated_digests_are_shuffled_in_full(table):
    """Rows meet the few repeated digests in a broadcast; what is grouped by whole rows comes after it."""
    documents = table("documents")
    for text in (plan(duplicate_counts(documents.drop("doc_id"))), plan(drop_duplicates(documents.drop("doc_id"), by_digest=True))):
        lines = text.splitlines()
        shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert shuffles and all("HashAggregate" in lines[i + 1] for i in shuffles)
        assert all(any("BroadcastHashJoin" in line and "LeftSemi" in line for line in lines[i:]) for i in shuffles)


def test_digests_compare_rows(spark, monkeypatch):
    """Nulls in other places, maps, zeros of either sign, NaN, and digests that clash."""
    nan = float("nan")
    data = [(1, None, {"a": 1}, 0.0), (None, 1, {"a": 1}, 0.0), (1, None, {"a": 1}, -0.0), (1, None, {"a": 2}, 0.0)]
    data += [(2, 2, None, nan)] * 40 + [(3, None, {}, None), (3, None, None, None)]
    df = spark.createDataFrame(data, "a int, b int, m map<string,int>, d double").repartition(5)
    assert tuple(duplicate_counts(df).first()) == (46, 6, 40)
    assert drop_duplicates(df, by_digest=True).count() == drop_duplicates(df).count() == 6
    assert tuple(duplicate_counts(df.limit(0)).first()) == (0, 0, 0)
    assert drop_duplicates(df.limit(0), by_digest=True).schema == df.schema
    assert tuple(duplicate_counts(df.where("a = 3")).first()) == (2, 2, 0)
    assert rows(drop_duplicates(df, ["a", "b"], by_digest=True), "a", "b") == [(None, 1), (1, None), (2, 2), (3, None)]
    monkeypatch.setattr(digests, "MOST_BROADCAST", 0)
    assert drop_duplicates(df, by_digest=True).count() == 6
    monkeypatch.setattr(digests, "digest", lambda df, columns: {"__digest0": F.lit(1), "__digest1": F.lit(2)})
    assert tuple(duplicate_counts(df).first()) == (46, 6, 40)
    assert drop_duplicates(df, by_digest=True).count() == 6


def test_issues(people):
    noisy = people.withColumn("source", F.lit("web"))
    found = [(r.column, r.issue, r.value) for r in quality_issues(noisy, {"max_length": 9}).collect()]
    assert set(found) == {
        (None, "duplicate_percentage", 16.67),
        ("city", "max_length", 10.0),
        ("department", "max_length", 12.0),
        ("email", "max_length", 10.0),
        ("email", "null_percentage", 33.33),
        ("source", "constant", 1.0),
    }
    assert len(found) == 6


def test_one_pass_gives_columns_and_table(spark, people):
    """The whole profile is what the two profiles say apart, also with copies, nulls and maps."""
    for df in (people, people.limit(0), people.withColumn("m", F.expr("map('k', age)")).drop("salary")):
        both = quality.profile_table(df)
        stats = ["dtype", "guessed_type", "row_count", "null_count", "null_percentage", "unique_count", "max_length"]
        stats += ["avg_length", "sample_values"]
        assert rows(both.select(F.inline("columns")), *stats) == rows(profile_columns(df), *stats)
        assert both.drop("columns").collect() == quality.profile_dataset(df).collect()


def test_samples_come_from_all_rows(spark):
    late = spark.range(0, 10_000, 1, 16).selectExpr("if(id < 9990, NULL, id) AS v")
    found = profile_columns(late, stats=["unique_count", "sample_values"], sample_values=20).first()
    assert found.unique_count == 10 and 1 <= len(found.sample_values) <= 8
    assert set(found.sample_values) <= {str(i) for i in range(9990, 10_000)}
