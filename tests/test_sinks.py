import pytest
from pyspark.sql import functions as F

from conftest import final_plan, rows
from pipekit.queries.storage import bucketed_join
from pipekit.sinks import database
from pipekit.sinks.files import export_files, stage, write_checked, write_datalake
from pipekit.sources.files import read_files


@pytest.fixture
def orders(table):
    return table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_lake_round_trip(spark, orders, tmp_path):
    path = str(tmp_path / "lake")
    write_datalake(orders, path, storage="local", partition_by=["o_orderstatus"])
    back = read_files(spark, path)
    assert same(back.select(orders.columns), orders)
    write_datalake(orders, path, storage="local", partition_by=["o_orderstatus"])
    assert read_files(spark, path).count() == 2 * orders.count()


def test_overwrite_replaces_only_the_partitions_written(spark, orders, tmp_path):
    path = str(tmp_path / "lake")
    write_datalake(orders, path, storage="local", partition_by=["o_orderstatus"])
    few = orders.filter("o_orderstatus = 'F'").limit(3)
    write_datalake(few, path, storage="local", partition_by=["o_orderstatus"], mode="overwrite")
    counts = dict(rows(read_files(spark, path).groupBy("o_orderstatus").count()))
    assert counts["F"] == 3 and counts["O"] == orders.filter("o_orderstatus = 'O'").count()


def test_a_hot_partition_is_split_and_small_ones_share_files(spark, tmp_path):
    """A value with most of the rows is written by several tasks, the others by few of the eight."""
    settings = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(0, 100_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(99).alias("p"), F.rand(1).alias("v")
        )
        write_datalake(df, str(tmp_path / "lake"), storage="local", partition_by=["p"])
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "lake").glob("p=*")}
    small = [files[f"p={i}"] for i in range(5)]
    assert files["p=99"] > 1 and sum(small) < 5 * 8 / 2


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_export_round_trip(spark, tmp_path, fmt):
    data = [(1, 'a "quoted", text', 1.5), (2, "two\nlines \\ slash", None), (3, "é 日本 😀", -2.0), (4, "'", 0.0)]
    df = spark.createDataFrame(data, "id int, t string, v double")
    export_files(df, str(tmp_path / "out"), fmt)
    assert rows(read_files(spark, str(tmp_path / "out"), schema=df.schema, multiline=True)) == data


def test_export_options_and_modes(spark, orders, tmp_path):
    path = str(tmp_path / "out")
    export_files(orders, path, "csv", {"sep": ";", "compression": "gzip"})
    assert list((tmp_path / "out").glob("*.csv.gz"))
    assert read_files(spark, path, options={"sep": ";"}).count() == orders.count()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        export_files(orders, path)
    export_files(orders.limit(1), path, mode="overwrite")
    assert read_files(spark, path).count() == 1


def test_rejections(orders, tmp_path):
    path = str(tmp_path / "x")
    for call in (
        lambda: export_files(orders, path, "xlsx"),
        lambda: export_files(orders, path, mode="merge"),
        lambda: write_datalake(orders, path, "csv", storage="local"),
        lambda: write_datalake(orders, path, mode="upsert", storage="local"),
    ):
        with pytest.raises(ValueError):
            call()
    for fmt in ("delta", "iceberg"):
        with pytest.raises(ValueError, match="class path"):
            write_datalake(orders, path, fmt, storage="local")


def test_write_checked(spark, orders, tmp_path):
    path, n = str(tmp_path / "lake"), orders.count()
    for loads in (1, 2):
        counts = write_checked(
            lambda seen: write_datalake(orders, path, partition_by=["o_orderstatus"], storage="local", seen=seen),
            lambda: read_files(spark, path),
        )
        assert counts == {"rows_written": n, "target_rows": loads * n}


def test_stage_cuts_the_lineage(orders):
    staged = stage(orders.filter("o_totalprice > 1000").withColumn("x", F.lit(1)))
    text = final_plan(staged)
    assert "Filter (" not in text and all("/stage-" in file for file in staged.inputFiles())
    assert staged.columns == [*orders.columns, "x"]


class Writer:
    """Stands in for a table, and keeps what a JDBC write would be given."""

    sparkSession = None

    def __init__(self):
        self.write, self.seen = self, {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def options(self, **options):
        self.seen.update(options)
        return self

    def mode(self, mode):
        self.seen["mode"] = mode
        return self

    def repartition(self, tasks):
        self.seen["tasks"] = tasks
        return self

    def observe(self, seen, *metrics):
        return self

    def save(self):
        self.seen["saved"] = True


class Seen:
    get = {"rows": 3}


def test_database_write_options(monkeypatch):
    monkeypatch.setattr(database, "Observation", Seen)
    writer = Writer()
    assert database.write_table(writer, "postgres", "processed.processed_data", "jdbc:postgresql://h/d") == 3
    assert writer.seen == {
        "format": "jdbc",
        "url": "jdbc:postgresql://h/d",
        "driver": "org.postgresql.Driver",
        "dbtable": "processed.processed_data",
        "batchsize": "50000",
        "numPartitions": "16",
        "tasks": 16,
        "mode": "append",
        "saved": True,
    }
    database.write_table(writer, "clickhouse", "t", "u", mode="overwrite", batch_size=10, options={"user": "me"})
    assert (writer.seen["truncate"], writer.seen["batchsize"], writer.seen["user"]) == ("true", "10", "me")
    with pytest.raises(ValueError):
        database.write_table(writer, "postgres", "t", "u", mode="merge")


def test_bucketed_tables_join_without_a_shuffle(spark, table):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = bucketed_join(table("orders"), table("lineitem"))
        text = final_plan(joined)
        assert text.count("SortMergeJoin") == 2 and text.count("HashAggregate") >= 2 and "Exchange" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = table("lineitem").groupBy("l_orderkey").count()
    plain = table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    assert rows(joined, "l_orderkey", "n") == rows(plain, "l_orderkey", "count")
