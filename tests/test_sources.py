import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from pipekit.queries import storage
from pipekit.sources import database, files
from pipekit.sources.files import bulk_import, detect_format, read_files, require_rows, storage_uri

CSV = '''id,email,city,score,flag
1,a@x.org,"New York, NY",1.5,TRUE
2,,Paris,1e3,false
3,"say ""hi""",,7,true
4,short
'''


@pytest.fixture
def folder(tmp_path):
    def write(**texts):
        for name, text in texts.items():
            path = tmp_path / name.replace("__", "/").replace("_dot_", ".").replace("_eq_", "=")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8")
        return str(tmp_path)

    return write


def test_csv(spark, folder):
    df = read_files(spark, folder(people_dot_csv=CSV), bad_rows="null")
    assert [t for _, t in df.dtypes] == ["int", "string", "string", "double", "boolean"]
    assert rows(df) == [
        (1, "a@x.org", "New York, NY", 1.5, True),
        (2, None, "Paris", 1000.0, False),
        (3, 'say "hi"', None, 7.0, True),
        (4, "short", None, None, None),
    ]


def test_csv_without_inference_and_from_a_sample(spark, folder):
    path = folder(people_dot_csv=CSV)
    assert {t for _, t in read_files(spark, path, infer=False).dtypes} == {"string"}
    sampled = read_files(spark, path, sample_rows=1)
    assert [t for _, t in sampled.dtypes] == ["int", "string", "string", "double", "boolean"]


def test_csv_rows_that_do_not_fit(spark, folder):
    path = folder(a_dot_csv="x,y\n1,a\nzwei,b\n3,c,extra\n")
    kept = read_files(spark, path, schema="x int, y string", bad_rows="keep")
    assert rows(kept) == [(None, "b", "zwei,b"), (1, "a", None), (3, "c", "3,c,extra")]
    assert rows(read_files(spark, path, schema="x int, y string", bad_rows="null")) == [(None, "b"), (1, "a"), (3, "c")]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ"):
        read_files(spark, path, schema="x int, y string").collect()
    with pytest.raises(ValueError):
        read_files(spark, path, bad_rows="drop")


def test_csv_line_breaks(spark, folder):
    path = folder(a_dot_csv='x,y\n1,"two\nlines"\n2,b\n')
    assert rows(read_files(spark, path, multiline=True)) == [(1, "two\nlines"), (2, "b")]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ"):
        read_files(spark, path, schema="x int, y string").collect()
    path = folder(b__a_dot_csv="x,y\n1,'two\nlines'\n2,b\n") + "/b"
    assert rows(read_files(spark, path, multiline=True, options={"quote": "'"})) == [(1, "two\nlines"), (2, "b")]


def test_a_sample_never_loses_values(spark, folder):
    """What does not fit the types of the first lines is an error, or kept beside the row."""
    path = folder(a_dot_csv="x\n1\n2\n 7 \nnan\nx7\n")
    assert [r.x for r in read_files(spark, path).collect()] == ["1", "2", " 7 ", "nan", "x7"]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ"):
        read_files(spark, path, sample_rows=2).collect()
    kept = read_files(spark, path, sample_rows=2, bad_rows="keep")
    assert kept.dtypes[0] == ("x", "int")
    assert rows(kept) == [(None, " 7 "), (None, "nan"), (None, "x7"), (1, None), (2, None)]


def test_a_cut_line_loses_only_itself(spark, folder):
    lines = [f'{{"a": {i}}}' for i in range(100)]
    path = folder(a_dot_json="\n".join([*lines[:50], '{"a": 5', *lines[50:]]) + "\n", b_dot_json="\n".join(lines))
    for multiline in (False, None):
        kept = read_files(spark, path, schema="a int", bad_rows="keep", multiline=multiline)
        found = rows(kept)
        assert len(found) == 201 and [r for r in found if r[1]] == [(None, '{"a": 5')]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ|Malformed"):
        read_files(spark, path, schema="a int").collect()


def test_json_documents_and_lines_side_by_side(spark, folder):
    path = folder(a_dot_json='\n [\n {"a": 1},\n {"a": 2.5}\n]', b_dot_json='{"a": 3}\n{"a": 4, "b": "x"}\n', c_dot_json="")
    df = read_files(spark, path, multiline=None)
    assert rows(df, "a", "b") == [(1.0, None), (2.5, None), (3.0, None), (4.0, "x")]
    with pytest.raises(Exception):
        read_files(spark, path).collect()


@pytest.mark.parametrize(
    "text",
    [
        '{"a": 1, "b": {"c": true}}\n{"a": 2}\n\n{"a": null, "b": {"c": false}}\n',
        '[{"a": 1, "b": {"c": true}}, {"a": 2}, {"a": null, "b": {"c": false}}]',
        '[\n {"a": 1,\n  "b": {"c": true}},\n {"a": 2},\n {"a": null, "b": {"c": false}}\n]\n',
    ],
)
def test_json_lines_and_arrays(spark, folder, text):
    df = read_files(spark, folder(a_dot_json=text), multiline=None)
    assert df.dtypes == [("a", "bigint"), ("b", "struct<c:boolean>")]
    assert rows(df, "a", "b.c") == [(None, False), (1, True), (2, None)]


def test_json_from_a_sample_and_as_text(spark, folder):
    path = folder(a_dot_ndjson='{"a": 1}\n{"a": 2.5, "b": 1}\n')
    assert read_files(spark, path, sample_rows=1, multiline=False).dtypes == [("a", "bigint")]
    assert read_files(spark, path, infer=False).dtypes == [("a", "string"), ("b", "string")]


def test_json_bad_records(spark, folder):
    path = folder(a_dot_json='{"a": 1}\n{"a": \n')
    kept = read_files(spark, path, schema="a int", bad_rows="keep", multiline=False)
    assert rows(kept) == [(None, '{"a": '), (1, None)]


def test_xml(spark, folder):
    path = folder(a_dot_xml="<rows><row><id>1</id><n>x</n></row><row><id>2</id></row></rows>")
    assert rows(read_files(spark, path)) == [(1, "x"), (2, None)]
    path = folder(b__b_dot_xml="<l><item><id>1</id></item></l>") + "/b"
    assert rows(read_files(spark, path, row_tag="item")) == [(1,)]


def test_parquet_reads_only_what_is_asked(spark):
    df = read_files(spark, "/root/testdata/sf0.001/orders.parquet").filter("o_custkey = 3").select("o_orderkey")
    text = plan(df)
    assert "EqualTo(o_custkey,3)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_format_detection(spark, folder):
    path = folder(x__a_dot_csv="a\n1\n", y__a_dot_csv="a\n1\n", y__b_dot_json='{"a": 1}', z__a_dot_txt="1")
    assert detect_format(spark, storage_uri(f"{path}/x")) == "csv"
    assert detect_format(spark, "s3a://bucket/a.csv.gz") == "csv"
    for mixed in ("y", "z"):
        with pytest.raises(ValueError):
            detect_format(spark, storage_uri(f"{path}/{mixed}"))


def test_guards(spark, folder):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_files(spark, "/tmp/no/such/file.csv")
    for fmt in ("xlsx", "docx"):
        with pytest.raises(ValueError):
            read_files(spark, "/tmp/a", fmt=fmt)
    with pytest.raises(ValueError, match="no rows"):
        require_rows(read_files(spark, folder(a_dot_csv="a,b\n")))


def test_storage_uris():
    assert storage_uri("/a/b", "local") == "file:///a/b"
    assert storage_uri("a/b") == "a/b" and storage_uri("hdfs:///a", None) == "hdfs:///a"
    assert storage_uri("bucket/a", "s3") == "s3a://bucket/a"
    assert storage_uri("bucket/a", "gcs") == "gs://bucket/a"
    assert storage_uri("/a", "hdfs") == "hdfs:///a"
    assert storage_uri("hdfs://nn:8020/a", "local") == "hdfs://nn:8020/a"
    for path, storage in (("a/b", "local"), ("/a", "ftp")):
        with pytest.raises(ValueError):
            storage_uri(path, storage)


def test_bulk_import(spark, folder):
    path = folder(
        in__day_eq_1__a_dot_csv="x\n1\n", in__day_eq_2__b_dot_csv="x\n2\n", in__day_eq_2__c_dot_json='{"x": 3}'
    )
    read = dict(storage="local", prefix="in")
    assert rows(bulk_import(spark, path, glob="**/*.csv", **read)) == [(1,), (2,)]
    assert rows(bulk_import(spark, path, glob="*/*.json", **read)) == [(3,)]
    named = bulk_import(spark, path, glob="**/*.csv", source_file=True, **read)
    assert {r.source_file.rsplit("/", 1)[1] for r in named.collect()} == {"a.csv", "b.csv"}
    with pytest.raises(ValueError):
        bulk_import(spark, path, **read)
    with pytest.raises(ValueError, match="partition folders"):
        bulk_import(spark, path, glob="**/*.csv", partition_by=["month"], **read)


def test_bulk_import_partitions_are_pruned(spark, tmp_path):
    spark.range(6).selectExpr("id", "id % 3 AS day").write.partitionBy("day").parquet(f"{tmp_path}/lake")
    df = bulk_import(spark, f"{tmp_path}/lake", storage="local", partition_by=["day"])
    assert rows(df.filter("day = 1")) == [(1, 1), (4, 1)]
    assert "PartitionFilters: [isnotnull(day" in plan(df.filter("day = 1"))
    one = bulk_import(spark, f"{tmp_path}/lake", glob="day=2/*", storage="local", partition_by=["day"])
    assert rows(one) == [(2, 2), (5, 2)]


# --- databases -----------------------------------------------------------------------------


class Recorder:
    """Stands in for a session, and keeps what a JDBC read would be given."""

    class conf:
        get = staticmethod({"spark.pipekit.mine.url": "jdbc:mine://h"}.get)

    def __init__(self):
        self.read, self.seen = self, {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def options(self, **options):
        self.seen.update(options)
        return self

    def load(self):
        return self.seen


def test_bind():
    sql = "SELECT ':x', a::int FROM t WHERE a = :x AND b > :y AND c = :z"
    bound = database.bind(sql, {"x": "O'Neil", "y": 1.5, "z": dt.date(2024, 1, 2)})
    assert bound == "SELECT ':x', a::int FROM t WHERE a = 'O''Neil' AND b > 1.5 AND c = DATE '2024-01-02'"
    assert database.bind(":a, :b, :c", {"a": None, "b": True, "c": dt.datetime(2024, 1, 2, 3)}) == (
        "NULL, TRUE, TIMESTAMP '2024-01-02 03:00:00'"
    )
    for bad in ({}, {"x": "back\\slash"}, {"x": [1]}):
        with pytest.raises(ValueError):
            database.bind("a = :x", bad)


def test_jdbc_options():
    query = database.read_query(Recorder(), "postgres", "SELECT :n", {"n": 3}, url="jdbc:postgresql://h/d")
    assert query == {
        "format": "jdbc",
        "url": "jdbc:postgresql://h/d",
        "driver": "org.postgresql.Driver",
        "query": "SELECT 3",
    }
    table = database.read_table(
        Recorder(), "clickhouse", "db.t", url="jdbc:ch://h", column="id", bounds=(0, 100), partitions=8
    )
    assert table["dbtable"] == "db.t" and table["driver"].startswith("com.clickhouse")
    assert [table[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")] == ["id", "0", "100", "8"]
    assert database.read_query(Recorder(), "mine", "SELECT 1")["url"] == "jdbc:mine://h"
    for call in (
        lambda: database.read_query(Recorder(), "postgres", "SELECT 1"),
        lambda: database.read_table(Recorder(), "postgres", "t"),
        lambda: database.read_table(Recorder(), "postgres", "t", url="u", column="id"),
    ):
        with pytest.raises(ValueError):
            call()


def test_aggregate_query():
    metrics = {"s": {"op": "sum", "col": "x"}, "n": {"op": "count"}, "d": {"op": "count_distinct", "col": 'q"t'}}
    assert database.aggregate_query("postgres", "s.t", ["g"], metrics) == (
        'SELECT "g", SUM("x") AS "s", COUNT(*) AS "n", COUNT(DISTINCT "q""t") AS "d" FROM "s"."t" GROUP BY "g"'
    )
    assert database.aggregate_query("spark", "t", [], {"n": {"op": "count"}}) == "SELECT COUNT(*) AS `n` FROM `t`"
    with pytest.raises(ValueError):
        database.aggregate_query("postgres", "t", [], {"m": {"op": "median", "col": "x"}})


def test_spark_engine_with_parameters(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert rows(database.read_query(spark, "spark", "SELECT id FROM ten WHERE id > :n", {"n": 7})) == [(8,), (9,)]
    assert database.read_table(spark, "spark", "ten").count() == 10


def test_suffix_table_is_complete():
    assert set(files.SUFFIX_FORMATS.values()) == set(files.FORMATS)


def test_sampled_schema_is_written_by_many_tasks(spark, monkeypatch):
    written, export = [], storage.export_files
    monkeypatch.setattr(storage, "export_files", lambda df, *rest: (written.append(df.rdd.getNumPartitions()), export(df, *rest)))
    code = F.when(F.col("id") % 10 == 9, 7).otherwise(F.col("id"))
    events = spark.range(0, 100, 1, 4).select(F.col("id").alias("event_id"), code.cast("long").alias("user_id"))
    found = storage.csv_sampled_schema(lambda name: events)
    assert max(written) == 4
    assert rows(found) == rows(events.selectExpr("event_id", "if(event_id % 10 = 9, null, user_id)", "if(event_id % 10 = 9, 'x7', null)"))
