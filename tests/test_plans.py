import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from conftest import final_plan, rows
from pipekit import session as sessions
from pipekit.plans import audit
from pipekit.plans.analyze import analyze_file
from pipekit.plans.etl import default_job, default_transform
from pipekit.plans.graph import NODES, run_graph
from pipekit.plans.partitions import make_partitions, partition_counts, partition_grid
from pipekit.sinks.files import write_datalake
from pipekit.sources.files import read_files


def names(df):
    return [r.partition for r in df.orderBy("starts_at").collect()]


def test_daily_and_hourly_partitions(spark):
    assert names(make_partitions(spark, "2025-01-30", "2025-02-01")) == ["2025-01-30", "2025-01-31", "2025-02-01"]
    hours = make_partitions(spark, "2025-01-01", "2025-01-01 02:30:00", "1h", fmt="YYYY/MM/DD HH")
    assert names(hours) == ["2025/01/01 00", "2025/01/01 01", "2025/01/01 02"]
    assert names(make_partitions(spark, "2024-12-29", "2025-01-02", "2d")) == ["2024-12-29", "2024-12-31", "2025-01-02"]
    assert names(make_partitions(spark, "2025-01-02", "2025-01-01")) == []


def test_partitions_up_to_now(spark):
    start = dt.datetime.now(dt.timezone.utc).date() - dt.timedelta(days=2)
    assert len(names(make_partitions(spark, str(start), "now"))) in (3, 4)
    with pytest.raises(ValueError):
        make_partitions(spark, "2025-01-01", "now", "1w")


def times(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("CAST(t AS timestamp_ntz) AS ts")


def test_counts_fill_gaps(spark):
    df = times(spark, "2025-01-01 05:10:00", "2025-01-01 05:50:00", "2025-01-01 08:00:00", None)
    counts = partition_counts(df, "ts", "1h", fmt="HH")
    assert rows(counts, "partition", "rows") == [("05", 2), ("06", 0), ("07", 0), ("08", 1)]
    assert names(partition_grid(df, "ts", "1h", fmt="HH")) == ["05", "06", "07", "08"]
    two = partition_counts(df, "ts", "2h", fmt="HH")
    assert rows(two, "partition", "rows") == [("05", 2), ("07", 1)]
    shifted = partition_counts(df, "ts", "1d", tz="America/Los_Angeles")
    assert rows(shifted, "partition", "rows") == [("2024-12-31", 2), ("2025-01-01", 1)]
    assert partition_counts(df.limit(0), "ts").isEmpty() and partition_grid(df.limit(0), "ts").isEmpty()


def test_counts_read_the_table_twice_at_most(table):
    assert final_plan(partition_counts(table("events"), "ts", "1h")).count("FileScan") <= 2


def test_audit(spark, tmp_path):
    path = str(tmp_path / "audit")
    audit.log_event(spark, path, pipeline="p", run_id="r1")
    payload = audit.log_event(spark, path, "done", "p", "r1", {"rows": 3}, {"by": "me"})
    assert payload == {"pipeline": "p", "run_id": "r1", "metrics": {"rows": 3}, "extra": {"by": "me"}}
    events = {r.event: r for r in audit.read_events(spark, path).collect()}
    assert events["mark"].metrics == {} and events["done"].metrics == {"rows": 3} and events["done"].ts


def test_default_transform(people):
    result = default_transform(people, "b1")
    assert result.columns == [*people.columns, "processed_at", "processing_batch_id"] and result.count() == 5
    row = result.filter("email = 'Unknown'").first()
    assert (row.city, row.department, row.salary) == ("Paris", "Sales", 25.0)


def test_default_job(spark, people, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    people.write.option("header", True).csv(source)
    default_job(spark, source, "b1", lambda df: write_datalake(df, target, storage="local"))
    back = read_files(spark, target)
    assert back.count() == 5 and back.filter("city = 'New York'").count() == 1
    with pytest.raises(ValueError, match="no rows"):
        people.limit(0).write.option("header", True).csv(f"{tmp_path}/none")
        default_job(spark, f"{tmp_path}/none", "b1", lambda df: None, fmt="csv", schema=people.schema)


def test_analyze_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,ok\n1,,true\n2,x,false\n2,x,false\n")
    dataset, columns = analyze_file(spark, str(tmp_path / "a.csv"))
    facts = dataset.first()
    assert (facts.row_count, facts.column_count, facts.total_nulls, facts.duplicate_rows) == (3, 3, 1, 1)
    assert [r.guessed_type for r in columns.collect()] == ["integer", "string", "boolean"]
    (tmp_path / "b.json").write_text('[{"id": 1, "ok": true}, {"id": 2.5}]')
    _, columns = analyze_file(spark, str(tmp_path / "b.json"))
    assert [(r.column, r.guessed_type, r.null_count) for r in columns.collect()] == [
        ("id", "number", 0),
        ("ok", "boolean", 1),
    ]


def test_graph_from_files_to_files(spark, people, tmp_path):
    source = str(tmp_path / "in.json")
    people.write.json(source)
    nodes = [
        {"id": "start", "op": "Orch.Trigger"},
        {"id": "read", "op": "Source.FileRead", "params": {"path": source, "format": "json", "sample_rows": 100}},
        {"id": "known", "op": "Clean.Nulls", "params": {"from": "read", "strategy": {"mode": "fill", "value": "?"}}},
        {"id": "text", "op": "Clean.Text", "params": {"from": "known", "columns": ["city"], "ops": ["trim", "lower"]}},
        {"id": "typed", "op": "Type.Cast", "params": {"from": "text", "casts": {"age": "Int32"}}},
        {"id": "once", "op": "Clean.Deduplicate", "params": {"from": "typed", "keys": ["email"], "keep": "first"}},
        {"id": "by", "op": "Transform.Aggregate", "params": {"from": "once", "group_by": ["city"], "metrics": {"n": {"op": "count"}}}},
        {"id": "both", "op": "Transform.Join", "params": {"left": "once", "right": "by", "on": ["city"]}},
        {"id": "wide", "op": "Transform.Pivot", "params": {"from": "both", "index": ["department"], "columns": ["city"], "values": ["n"]}},
        {"id": "best", "op": "Transform.SortRank", "params": {"from": "both", "order_by": [{"col": "age", "dir": "desc"}], "top_n": 2}},
        {"id": "profile", "op": "DQ.Profile", "params": {"from": "both", "sample": 50}},
        {"id": "shape", "op": "Schema.Infer", "params": {"from": "both", "sample_rows": 50}},
        {"id": "days", "op": "Orch.Partitioning", "params": {"start": "2025-01-01", "end": "2025-01-03"}},
        {"id": "lake", "op": "Sink.DataLake", "params": {"from": "both", "path": f"{tmp_path}/lake", "storage": "local"}},
        {"id": "out", "op": "Sink.Files", "params": {"from": "best", "path": f"{tmp_path}/out", "format": "csv"}},
        {"id": "log", "op": "Audit.Log", "params": {"path": f"{tmp_path}/audit", "pipeline": "p", "run_id": "1"}},
    ]
    tables = run_graph(spark, nodes)
    assert read_files(spark, f"{tmp_path}/lake").count() == tables["both"].count() == 5
    assert [r.age for r in tables["best"].collect()] == [60, 41]
    assert read_files(spark, f"{tmp_path}/out").count() == 2
    assert tables["days"].count() == 3 and tables["wide"].count() == 5
    assert {r.column for r in tables["profile"].collect()} == {r.column for r in tables["shape"].collect()}


def test_graph_over_views(spark, people):
    people.createOrReplaceTempView("graph_people")
    tables = run_graph(
        spark,
        [
            {"id": "q", "op": "Source.DBQuery", "params": {"engine": "spark", "sql": "SELECT * FROM graph_people WHERE age > :a", "sql_params": {"a": 40}}},
            {"id": "a", "op": "Transform.Aggregate", "params": {"engine": "spark", "table": "graph_people", "metrics": {"n": {"op": "count"}}, "group_by": []}},
            {"id": "p", "op": "DQ.Profile", "params": {"engine": "spark", "table": "graph_people", "stats": ["null_count"]}},
            {"id": "f", "op": "Transform.Filter", "params": {"from": "more", "condition": "id = 1"}},
        ],
        more=people,
    )
    assert tables["q"].count() == 2 and tables["a"].first().n == 6 and tables["f"].count() == 2
    assert {r.column: r.null_count for r in tables["p"].collect()}["email"] == 2


def test_edges_order_nodes_and_share_what_several_sinks_read(spark, people, tmp_path):
    people.write.parquet(f"{tmp_path}/source")
    nodes = [
        {"id": "log", "op": "Audit.Log", "params": {"path": f"{tmp_path}/audit", "pipeline": "p", "run_id": "1"}},
        {"id": "two", "op": "Sink.Files", "params": {"path": f"{tmp_path}/two", "format": "json"}},
        {"id": "one", "op": "Sink.DataLake", "params": {"path": f"{tmp_path}/one", "format": "parquet"}},
        {"id": "old", "op": "Transform.Filter", "params": {"condition": "age > 40"}},
        {"id": "known", "op": "Clean.Nulls", "params": {"strategy": {"mode": "drop", "columns": ["age"]}}},
        {"id": "both", "op": "Transform.Join", "params": {"on": ["id"], "how": "inner"}},
        {"id": "source", "op": "Source.FileRead", "params": {"path": f"{tmp_path}/source"}},
        {"id": "start", "op": "Orch.Trigger"},
    ]
    edges = [("start", "source"), ("source", "known"), ("known", "one"), ("known", "old"), ("old", "two")]
    edges += [("one", "log"), ("two", "log"), ("known", "both"), ("old", "both")]
    tables = run_graph(spark, nodes, edges)
    assert spark.read.parquet(f"{tmp_path}/one").count() == 5 and spark.read.json(f"{tmp_path}/two").count() == 2
    assert tables["both"].count() == 1 and "id" in tables["both"].columns
    assert audit.read_events(spark, f"{tmp_path}/audit").first().metrics == {"rows": 5}
    # What both sinks read was written once: no plan after it reads the source.
    reads = lambda name: any(f"{tmp_path}/source/" in file for file in tables[name].inputFiles())
    assert reads("source") and not any(map(reads, ("known", "old", "both")))


@pytest.mark.parametrize(
    "edges, said",
    [
        ([("a", "b"), ("b", "c"), ("c", "a")], "wait for each other"),
        ([("a", "a")], "wait for each other"),
        ([("people", "a"), ("z", "b")], "no nodes"),
        ([("a", "people")], "given"),
    ],
)
def test_edges_that_cannot_be(spark, people, edges, said):
    nodes = [{"id": name, "op": "Orch.Trigger"} for name in "abc"]
    with pytest.raises(ValueError, match=said):
        run_graph(spark, nodes, edges, people=people)


def test_graph_errors(spark, people):
    for nodes in (
        [{"id": "a", "op": "AI.Report"}],
        [{"id": "a", "op": "Clean.Text", "params": {"from": "later", "columns": ["x"]}}],
        [{"id": "people", "op": "Orch.Trigger"}],
    ):
        with pytest.raises(ValueError):
            run_graph(spark, nodes, people=people)
    assert len(NODES) == 21


def test_sizes():
    small, large = sessions.sized(10**9), sessions.sized(10**14)
    scan, shuffle = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert (int(small[scan]), int(small[shuffle])) == (128 * 2**20, 200)
    assert (int(large[scan]), int(large[shuffle])) == (10**9, 20_000)


def test_scratch_folder(spark, monkeypatch):
    class Other:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master, applicationId = "yarn", "app"

    with pytest.raises(ValueError, match="checkpoint"):
        sessions.scratch_dir(Other)
    Other.conf.get = staticmethod(lambda key, default: "hdfs:///shared/")
    assert sessions.scratch_dir(Other) == "hdfs:///shared"
    Other.conf.get = staticmethod(lambda key, default: None)
    for cluster in ("local-cluster[2,1,1024]", "k8s://h"):
        Other.sparkContext.master = cluster
        with pytest.raises(ValueError, match="checkpoint"):
            sessions.scratch_dir(Other)
    Other.sparkContext.master = "local[2]"
    monkeypatch.setattr(sessions, "_own_folders", {})
    assert sessions.scratch_dir(Other) == sessions.scratch_dir(Other) == sessions._own_folders["app"]


def test_scratch_is_removed_on_request(spark, people):
    path = sessions.fresh_path(spark, "table")
    people.write.parquet(path)
    folder = pathlib.Path(path.removeprefix("file://")).parent
    kept = folder.rename(folder.with_name("kept"))
    people.write.parquet(path)
    assert sessions.remove_scratch(spark) and not folder.exists() and not sessions.remove_scratch(spark)
    kept.rename(folder)


def test_sinks_and_profiles_in_a_graph(spark, people, tmp_path):
    nodes = [
        {"id": "lake", "op": "Sink.DataLake", "params": {"from": "people", "path": f"{tmp_path}/lake"}},
        {"id": "log", "op": "Audit.Log", "params": {"from": "lake", "path": f"{tmp_path}/audit", "event": "load"}},
        {"id": "columns", "op": "DQ.Profile", "params": {"from": "people"}},
        {"id": "report", "op": "DQ.Profile", "params": {"from": "people", "path": f"{tmp_path}/report"}},
    ]
    done = run_graph(spark, nodes, people=people)
    assert audit.read_events(spark, f"{tmp_path}/audit").first().metrics == {"rows": 6}
    assert done["columns"].count() == 6
    report = done["report"].first()
    assert (report.row_count, report.duplicate_rows, len(report.columns)) == (6, 1, 6)


def test_grids_of_many_steps(spark):
    """Two times far apart are no single array."""
    df = times(spark, "1900-01-01 00:30:00", "2100-01-01 00:00:00")
    assert partition_grid(df, "ts", "1h").count() == (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days * 24 + 1
    assert names(make_partitions(spark, "2025-01-01 05:00:00", "2025-01-03 04:59:59")) == ["2025-01-01", "2025-01-02"]


def test_long_grids_are_made_by_many_tasks(spark):
    grid = make_partitions(spark, "1900-01-01", "2100-01-01", "1h")
    tasks = grid.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < sum(r["count"] for r in tasks)
