import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import plan, rows
from pipekit.functions.text import WHITESPACE, remove_emoji, strip, title_case
from pipekit.operators import clean


def day(n):
    return dt.datetime(2024, 1, n)


@pytest.fixture
def versions(spark):
    data = [
        ("a", day(1), "old"),
        ("a", day(3), "tie1"),
        ("a", day(3), "tie2"),
        ("a", None, "undated"),
        ("b", None, "only"),
        (None, day(2), "x"),
        (None, day(1), "y"),
    ]
    return spark.createDataFrame(data, "k string, ts timestamp_ntz, v string")


@pytest.mark.parametrize(
    "keep, expected",
    [
        ("last", [(None, "x"), ("a", "tie2"), ("b", "only")]),
        ("first", [(None, "y"), ("a", "old"), ("b", "only")]),
    ],
)
def test_deduplicate_by_time(versions, keep, expected):
    result = clean.deduplicate(versions, ["k"], "ts", keep)
    assert result.columns == versions.columns and result.schema == versions.schema
    assert rows(result, "k", "v") == expected


def test_deduplicate_without_time_uses_the_other_columns(versions):
    assert rows(clean.deduplicate(versions, ["k"], keep="last"), "k", "v") == [(None, "x"), ("a", "tie2"), ("b", "only")]


def test_deduplicate_is_idempotent_and_counts_add_up(table):
    lines = table("lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    once = clean.deduplicate(lines, keys, "l_shipdate")
    twice = clean.deduplicate(once, keys, "l_shipdate")
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()
    counts = clean.duplicate_counts(lines, keys).first()
    assert counts.kept + counts.removed == counts.input_rows == lines.count()
    assert counts.kept == once.count()


def test_deduplicate_keeps_maps_and_nested_values(spark):
    df = spark.sql("SELECT id % 2 AS k, id AS v, map('a', id) AS m, named_struct('x', id) AS s FROM range(6)")
    result = clean.deduplicate(df, ["k"], "v", "first")
    assert [(r.k, r.v, r.m, r.s.x) for r in result.orderBy("k").collect()] == [(0, 0, {"a": 0}, 0), (1, 1, {"a": 1}, 1)]


def test_deduplicate_sends_one_row_per_key_and_task(table):
    lines = plan(clean.deduplicate(table("events"), ["event_type"], "ts")).splitlines()
    shuffle = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert "WindowGroupLimit" in lines[shuffle + 1]


def test_deduplicate_rejects_bad_arguments(versions):
    with pytest.raises(ValueError):
        clean.deduplicate(versions, ["k"], keep="any")
    with pytest.raises(ValueError):
        clean.deduplicate(versions, [])
    with pytest.raises(ValueError):
        clean.deduplicate(versions, ["nope"])


def test_drop_duplicates_and_counts(people):
    assert clean.drop_duplicates(people).count() == 5
    assert tuple(clean.duplicate_counts(people).first()) == (6, 5, 1)
    assert tuple(clean.duplicate_counts(people.limit(0)).first()) == (0, 0, 0)


def test_duplicate_counts_of_maps(spark):
    df = spark.sql("SELECT map('a', id % 3) AS m, array(id % 3) AS a FROM range(10)")
    assert tuple(clean.duplicate_counts(df).first()) == (10, 3, 7)
    assert tuple(clean.duplicate_counts(df, ["m"]).first()) == (10, 3, 7)


def test_nulls_drop(people):
    assert rows(clean.handle_nulls(people), "id") == [(1,), (1,)]
    assert clean.handle_nulls(people, {"mode": "drop", "columns": ["email"]}).count() == 5


def test_nulls_fill(people):
    filled = clean.handle_nulls(people, {"mode": "fill", "value": 0, "columns": ["salary", "age", "city"]})
    assert rows(filled.filter("id in (2, 3, 4)"), "salary", "age", "city") == [
        (0.0, 25, "oslo"),
        (0.0, 41, "PARIS"),
        (30.0, 0, "0"),
    ]
    assert filled.schema["age"].dataType == people.schema["age"].dataType
    with pytest.raises(ValueError):
        clean.handle_nulls(people, {"mode": "guess"})
    with pytest.raises(ValueError):
        clean.handle_nulls(people, {"mode": "fill"})


def test_fill_by_type(people):
    filled = clean.fill_by_type(people)
    by_id = {r.id: r for r in filled.collect()}
    assert by_id[2].email == "Unknown" and by_id[3].city == "Unknown" and by_id[4].department == "Unknown"
    assert by_id[2].salary == by_id[4].salary == 25.0
    assert by_id[3].age == (30 + 30 + 41 + 25 + 60) / 5
    assert (1 + 1 + 2 + 3 + 4) / 5 in by_id


def test_fill_by_type_goes_by_the_schema(spark):
    """Integers become double, whether or not this table has nulls in them."""
    data = [(7, 1, True, None), (8, None, None, day(1))]
    df = spark.createDataFrame(data, "a bigint, b int, c boolean, d timestamp_ntz")
    filled = clean.fill_by_type(df)
    assert filled.schema == clean.fill_by_type(df.limit(0)).schema
    assert filled.schema["a"].dataType.simpleString() == filled.schema["b"].dataType.simpleString() == "double"
    assert rows(filled) == [(7.0, 1.0, True, None), (8.0, 1.0, None, day(1))]


def test_deduplicate_counted(people):
    kept, counts = clean.deduplicate_counted(people, ["id"])
    assert kept.count() == 5 and counts() == {"input_rows": 6, "kept": 5, "removed": 1}


def test_standardize_text(people):
    cities = {r.id: (r.city, r.department, r.email) for r in clean.standardize_text(people).collect()}
    assert cities[1] == ("New York", "O'Neil-Smith", "Anna@X.Org")
    assert cities[3] == (None, "Éa Team", "Bob@Y.Org")
    assert cities[None] == ("Rome", "R2D2", "")


def test_standardize_matches_names_without_case(spark):
    df = spark.createDataFrame([("a b", "a b")], "CITY string, town string")
    assert tuple(clean.standardize_text(df).first()) == ("A B", "a b")


TEXTS = st.text(alphabet=st.sampled_from(list("abcXYZ éÀñß'’-_.,0123 \t\n  日本")), max_size=30)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXTS, min_size=1, max_size=50))
def test_strip_and_title_agree_with_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", strip(F.col("t")).alias("s"), title_case(F.col("t")).alias("title")).collect():
        assert row.s == row.t.strip()
        assert row.title == row.t.title()


def test_strip_removes_what_python_strips():
    assert not WHITESPACE.strip() and len(set(WHITESPACE)) == sum(chr(c).isspace() for c in range(0x110000))


def test_remove_emoji(spark):
    cases = {
        "hi 👩‍💻!": "hi !",
        "☕️ time": " time",
        "#️⃣1": "#1",
        "a‍b": "a‍b",
        "café 50% # *": "café 50% # *",
        "🇫🇷🏴󠁧󠁢󠁥󠁮󠁧󠁿x": "x",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for row in df.withColumn("got", remove_emoji(F.col("t"))).collect():
        assert row.got == row.want


def test_normalize_text_in_order(spark):
    df = spark.createDataFrame([(" 😀 ABC ",)], "t string")
    assert clean.normalize_text(df, ["t"]).first().t == " abc"
    assert clean.normalize_text(df, ["t"], ["rm_emoji", "trim"]).first().t == "ABC"
    with pytest.raises(ValueError):
        clean.normalize_text(df, ["t"], ["shout"])


def test_batch_columns_and_empty_text(people):
    stamped = clean.add_batch_columns(people, "run-1")
    assert stamped.filter("processed_at IS NULL OR processing_batch_id <> 'run-1'").isEmpty()
    assert clean.empty_to_null(people).filter("email IS NULL").count() == 2


def test_filter_reaches_the_scan(table):
    scan = plan(clean.filter_rows(table("lineitem"), "l_quantity > 49").select("l_orderkey"))
    assert "GreaterThan(l_quantity,49.0)" in scan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in scan
