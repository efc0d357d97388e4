"""Round trips through files, queries over views, partition grids, audit rows and node graphs.

What these queries write goes to fresh folders below the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from pipekit.operators.aggregate import aggregate
from pipekit.plans.audit import log_event, read_events
from pipekit.plans.etl import default_job
from pipekit.plans.graph import run_graph
from pipekit.plans.partitions import partition_counts, partition_grid
from pipekit.queries.registry import Tables, query
from pipekit.session import fresh_path
from pipekit.sinks.files import export_files, stage, stage_buckets, write_checked, write_datalake
from pipekit.sources.database import aggregate_in_engine, read_query, read_table
from pipekit.sources.files import bulk_import, read_files, require_rows

DOCUMENTS_SQL = "SELECT doc_id, text, lang, n_chars FROM documents"
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"


def _documents(table: Tables) -> DataFrame:
    return table("documents").select("doc_id", "text", "lang", "n_chars")


def _orders(table: Tables) -> DataFrame:
    return table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def _path(df: DataFrame, label: str) -> str:
    return fresh_path(df.sparkSession, label)


# --- files ---------------------------------------------------------------------------------


@query("csv_roundtrip", ORDERS_SQL)
def csv_roundtrip(table: Tables) -> DataFrame:
    """Types are inferred from the text."""
    orders = _orders(table)
    path = _path(orders, "csv")
    export_files(orders, path, "csv")
    back = require_rows(read_files(orders.sparkSession, path))
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "timestamp_ntz"}
    return back.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


@query("csv_quoted_text", DOCUMENTS_SQL)
def csv_quoted_text(table: Tables) -> DataFrame:
    """Whole texts, with quotes, commas and line breaks inside."""
    documents = _documents(table)
    path = _path(documents, "csv")
    export_files(documents, path, "csv")
    return read_files(documents.sparkSession, path, fmt="csv", schema=documents.schema, multiline=True)


@query(
    "json_bad_lines",
    """
    SELECT event_type, count(*) FILTER (event_id % 7 <> 0) AS good, count(*) FILTER (event_id % 7 = 0) AS bad
    FROM events GROUP BY ALL
    """,
)
def json_bad_lines(table: Tables) -> DataFrame:
    """JSON lines of which every seventh is cut; what is left of them is kept beside the rows."""
    events = table("events").select("event_id", "event_type")
    spark, path = events.sparkSession, _path(events, "json")
    line = F.to_json(F.struct("event_type", "event_id"))
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    events.withColumn("line", line).select(cut.alias("value")).write.text(path)
    back = read_files(spark, path, fmt="json", schema="event_id bigint, event_type string", bad_rows="keep")
    bad = F.col("_corrupt_record").isNotNull()
    kind = F.when(bad, F.regexp_extract("_corrupt_record", '"event_type":"(.*?)"', 1)).otherwise(F.col("event_type"))
    counts = back.groupBy(kind.alias("event_type"))
    return counts.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))


@query(
    "csv_sampled_schema",
    """
    SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE user_id END AS code,
           CASE WHEN event_id % 10 = 9 THEN 'x' || user_id END AS misfit
    FROM events
    """,
)
def csv_sampled_schema(table: Tables) -> DataFrame:
    """Types from the first nine lines, in a file of their own; later values that do not fit them are kept as text."""
    code = F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("x"), "user_id")).otherwise(F.col("user_id").cast("string"))
    events = table("events").select(F.col("event_id"), code.alias("code"))
    spark, path, head = events.sparkSession, _path(events, "csv"), _path(events, "head")
    export_files(events, path, "csv")
    export_files(events.orderBy("event_id").limit(9), head, "csv")
    back = read_files(spark, path, schema=read_files(spark, head, sample_rows=9).schema, bad_rows="keep")
    misfit = F.regexp_extract("_corrupt_record", ",(x[0-9]+)$", 1)
    return back.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("code").cast("bigint").alias("code"),
        F.nullif(misfit, F.lit("")).alias("misfit"),
    )


@query(
    "default_job",
    """
    SELECT coalesce(user_id, 0)::DOUBLE AS user_id, event_type AS city,
           round(coalesce(v, (SELECT avg(v) FROM (SELECT CASE WHEN event_id % 4 > 0 THEN value END AS v FROM events))), 6) AS value,
           'b-7' AS processing_batch_id
    FROM (SELECT DISTINCT user_id, upper(event_type[1]) || event_type[2:] AS event_type,
                 CASE WHEN event_id % 4 > 0 THEN value END AS v FROM events)
    """,
)
def whole_default_job(table: Tables) -> DataFrame:
    """Files read, filled, de-duplicated, standardised, stamped and written to a lake."""
    value = F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("value")
    events = table("events").select("user_id", F.col("event_type").alias("city"), value)
    spark, source, target = events.sparkSession, _path(events, "source"), _path(events, "target")
    export_files(events, source, "json")
    default_job(spark, source, "b-7", lambda df: write_datalake(df, target))
    back = read_files(spark, target)
    return back.select("user_id", "city", F.round("value", 6).alias("value"), "processing_batch_id")


@query("json_roundtrip", DOCUMENTS_SQL)
def json_roundtrip(table: Tables) -> DataFrame:
    documents = _documents(table)
    path = _path(documents, "json")
    export_files(documents, path, "json")
    return read_files(documents.sparkSession, path).select("doc_id", "text", "lang", "n_chars")


@query("xml_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def xml_roundtrip(table: Tables) -> DataFrame:
    customers = table("customer").select("c_custkey", "c_name", "c_acctbal")
    path = _path(customers, "xml")
    customers.write.format("xml").option("rowTag", "row").save(path)
    return read_files(customers.sparkSession, path).select("c_custkey", "c_name", "c_acctbal")


@query("parquet_stage", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def parquet_stage(table: Tables) -> DataFrame:
    staged = stage(table("orders"))
    metrics = {"n": {"op": "count"}, "customers": {"op": "count_distinct", "col": "o_custkey"}}
    return aggregate(staged, metrics=metrics)


@query(
    "staged_buckets",
    """
    SELECT o_orderpriority, count(*) AS orders, sum(n) AS lines, sum(late) AS late
    FROM orders
    JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON o_orderkey = a.l_orderkey
    JOIN (SELECT l_orderkey, count(*) FILTER (l_shipdate > TIMESTAMP '2023-01-01') AS late FROM lineitem GROUP BY 1) b
      ON o_orderkey = b.l_orderkey
    GROUP BY ALL
    """,
)
def staged_buckets(table: Tables) -> DataFrame:
    """Two joins and two aggregates on one key, of tables that were dealt out by it once."""
    joined = bucketed_join(table("orders"), table("lineitem"))
    return joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"), F.sum("late").alias("late")
    )


def bucketed_join(orders: DataFrame, lines: DataFrame) -> DataFrame:
    orders = stage_buckets(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), ["l_orderkey"], 8)
    lines = stage_buckets(lines.select("l_orderkey", "l_shipdate"), ["l_orderkey"], 8)
    late = F.count_if(F.col("l_shipdate") > F.lit("2023-01-01").cast("timestamp_ntz")).alias("late")
    counts = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return orders.join(counts, "l_orderkey").join(lines.groupBy("l_orderkey").agg(late), "l_orderkey")


@query(
    "sink_roundtrip_partitioned",
    """
    SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
    """,
)
def sink_roundtrip_partitioned(table: Tables) -> DataFrame:
    """The filter on the folder column prunes the folders."""
    orders = table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    path = _path(orders, "lake")
    write_datalake(orders, path, partition_by=["o_orderstatus"])
    return read_files(orders.sparkSession, path).filter("o_orderstatus = 'F'")


@query(
    "sink_overwrite_partitions",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus
    FROM orders
    """,
)
def sink_overwrite_partitions(table: Tables) -> DataFrame:
    """Overwriting with the rows of one partition leaves the other partitions alone."""
    orders = table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = _path(orders, "lake")
    write_datalake(orders, path, partition_by=["o_orderstatus"])
    zeros = orders.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0))
    write_datalake(zeros, path, partition_by=["o_orderstatus"], mode="overwrite")
    return read_files(orders.sparkSession, path)


@query(
    "sink_check",
    "SELECT count(*) AS rows_written, 2 * count(*) AS target_rows FROM orders",
)
def sink_check(table: Tables) -> DataFrame:
    """Two loads of the same rows: what the second one wrote, and what the target then holds."""
    orders = _orders(table)
    spark, path = orders.sparkSession, _path(orders, "target")
    write_datalake(orders, path, partition_by=["o_orderstatus"])
    counts = write_checked(
        lambda seen: write_datalake(orders, path, partition_by=["o_orderstatus"], seen=seen),
        lambda: read_files(spark, path),
    )
    return spark.createDataFrame([counts], "rows_written bigint, target_rows bigint")


@query(
    "bulk_import_folders",
    "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
)
def bulk_import_folders(table: Tables) -> DataFrame:
    events = table("events")
    path = _path(events, "bulk")
    write_datalake(events, path, partition_by=["event_type"])
    back = bulk_import(events.sparkSession, path, storage=None, partition_by=["event_type"])
    metrics = {"n": {"op": "count"}, "total": {"op": "sum", "col": "value"}}
    return aggregate(back, ["event_type"], metrics).withColumn("total", F.round("total", 2))


@query(
    "bulk_import_glob",
    """
    SELECT user_id % 4 AS part, count(*) AS n, 'json' AS kind FROM events GROUP BY ALL
    """,
)
def bulk_import_glob(table: Tables) -> DataFrame:
    """JSON files picked by name from several folders that also hold others."""
    events = table("events").select("event_id", (F.col("user_id") % 4).alias("part"))
    spark, path = events.sparkSession, _path(events, "bulk")
    write = events.withColumn("folder", F.col("part")).write.partitionBy("folder")
    write.json(f"{path}/in")
    write.mode("append").csv(f"{path}/in")
    back = bulk_import(spark, path, "in", "**/*.json", storage=None, source_file=True)
    kind = F.regexp_extract("source_file", r"\.([a-z]+)$", 1).alias("kind")
    return back.groupBy("part", kind).agg(F.count(F.lit(1)).alias("n"))


# --- queries over views --------------------------------------------------------------------


@query(
    "sql_query_params",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice > 250000 AND o_orderdate >= TIMESTAMP '1997-06-01'
    """,
)
def sql_query_params(table: Tables) -> DataFrame:
    orders = table("orders")
    orders.createOrReplaceTempView("pipekit_orders")
    sql = """
        SELECT o_orderkey, o_totalprice FROM pipekit_orders
        WHERE o_orderstatus = :status AND o_totalprice > :least AND o_orderdate >= CAST(:since AS timestamp_ntz)
    """
    params = {"status": "O", "least": 250_000, "since": "1997-06-01"}
    return read_query(orders.sparkSession, "spark", sql, params)


@query("table_scan", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def table_scan(table: Tables) -> DataFrame:
    customers = table("customer")
    customers.createOrReplaceTempView("pipekit_customer")
    return aggregate(
        read_table(customers.sparkSession, "spark", "pipekit_customer"), ["c_nationkey"], {"n": {"op": "count"}}
    )


@query(
    "aggregate_in_engine",
    """
    SELECT l_returnflag, sum(l_quantity) AS qty, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers
    FROM lineitem GROUP BY ALL
    """,
)
def aggregate_by_engine(table: Tables) -> DataFrame:
    lines = table("lineitem")
    lines.createOrReplaceTempView("pipekit_lineitem")
    metrics = {
        "qty": {"op": "sum", "col": "l_quantity"},
        "n": {"op": "count"},
        "suppliers": {"op": "count_distinct", "col": "l_suppkey"},
    }
    return aggregate_in_engine(lines.sparkSession, "spark", "pipekit_lineitem", ["l_returnflag"], metrics)


# --- partitions, audit, graphs -------------------------------------------------------------


@query(
    "partition_grid",
    """
    SELECT strftime(d, '%Y-%m-%d') AS partition, d AS starts_at
    FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 1 DAY)) AS d FROM events)
    """,
)
def grid(table: Tables) -> DataFrame:
    return partition_grid(table("events"), "ts")


@query(
    "partition_counts",
    """
    WITH g AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), max(ts), INTERVAL 1 HOUR)) AS h
               FROM events WHERE event_type = 'error'),
         e AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT strftime(g.h, '%Y%m%d-%H') AS partition, g.h AS starts_at, coalesce(n, 0) AS rows
    FROM g LEFT JOIN e ON g.h = e.h
    """,
)
def counts(table: Tables) -> DataFrame:
    errors = table("events").filter("event_type = 'error'")
    return partition_counts(errors, "ts", every="1h", fmt="YYYYMMDD-HH")


@query(
    "partition_counts_wide",
    """
    WITH o AS (SELECT timezone('Asia/Tokyo', timezone('UTC', ts)) AS ts FROM events),
         b AS (SELECT date_trunc('day', min(ts)) AS first, max(ts) AS last FROM o),
         g AS (SELECT unnest(generate_series(first, last, INTERVAL 3 DAY)) AS d FROM b)
    SELECT strftime(d, '%Y-%m-%d') AS partition, d AS starts_at,
           (SELECT count(*) FROM o WHERE ts >= d AND ts < d + INTERVAL 3 DAY) AS rows
    FROM g
    """,
)
def counts_wide(table: Tables) -> DataFrame:
    return partition_counts(table("events"), "ts", every="3d", tz="Asia/Tokyo")


@query(
    "audit_log",
    """
    SELECT 'load' AS event, 'nightly' AS pipeline, 'run-1' AS run_id, count(*) AS rows, 'orders' AS target
    FROM orders
    """,
)
def audit_log(table: Tables) -> DataFrame:
    """Metrics observed during a write, logged and read back."""
    orders = table("orders").select("o_orderkey", "o_orderstatus")
    spark = orders.sparkSession
    seen = Observation()
    write_datalake(orders, _path(orders, "target"), seen=seen)
    path = fresh_path(spark, "audit")
    log_event(spark, path, "load", "nightly", "run-1", seen.get, {"target": "orders"})
    events = read_events(spark, path)
    rows, target = F.col("metrics")["rows"], F.col("extra")["target"]
    return events.select("event", "pipeline", "run_id", rows.alias("rows"), target.alias("target"))


@query(
    "node_graph",
    """
    WITH t AS (SELECT c_mktsegment, o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
               FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL)
    SELECT c_mktsegment, o_orderpriority, CAST(total AS DOUBLE) AS total,
           row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC) AS rank
    FROM t QUALIFY rank <= 2
    """,
)
def node_graph(table: Tables) -> DataFrame:
    orders = table("orders").withColumnRenamed("o_custkey", "c_custkey")
    nodes = [
        {"id": "open", "op": "Transform.Filter", "params": {"from": "orders", "condition": "o_orderstatus <> 'P'"}},
        {
            "id": "typed",
            "op": "Type.Cast",
            "params": {"from": "open", "casts": {"o_totalprice": "Decimal(18,2)"}},
        },
        {
            "id": "joined",
            "op": "Transform.Join",
            "params": {"left": "typed", "right": "customer", "on": ["c_custkey"], "how": "inner"},
        },
        {
            "id": "totals",
            "op": "Transform.Aggregate",
            "params": {
                "from": "joined",
                "group_by": ["c_mktsegment", "o_orderpriority"],
                "metrics": {"total": {"op": "sum", "col": "o_totalprice"}},
            },
        },
        {
            "id": "best",
            "op": "Transform.SortRank",
            "params": {
                "from": "totals",
                "order_by": [{"col": "total", "dir": "desc"}],
                "partition_by": ["c_mktsegment"],
                "top_n": 2,
            },
        },
        {"id": "out", "op": "Type.Cast", "params": {"from": "best", "casts": {"total": "Float64"}}},
    ]
    return run_graph(orders.sparkSession, nodes, orders=orders, customer=table("customer"))["out"]


@query(
    "node_graph_edges",
    """
    WITH t AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
    SELECT 'lines' AS sink, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM t GROUP BY ALL
    UNION ALL
    SELECT 'totals', o_orderpriority, count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
    FROM t WHERE o_orderkey % 2 = 0 GROUP BY ALL
    """,
)
def node_graph_edges(table: Tables) -> DataFrame:
    """Nodes in no order, tied by edges; two sinks read what their common node made, written once."""
    orders = table("orders")
    spark = orders.sparkSession
    lines, totals = _path(orders, "lines"), _path(orders, "totals")
    metrics = {"n": {"op": "count"}, "total": {"op": "sum", "col": "o_totalprice"}}
    nodes = [
        {"id": "totals", "op": "Sink.DataLake", "params": {"path": totals, "format": "parquet"}},
        {"id": "sums", "op": "Transform.Aggregate", "params": {"group_by": ["o_orderpriority"], "metrics": metrics}},
        {"id": "even", "op": "Transform.Filter", "params": {"condition": "o_orderkey % 2 = 0"}},
        {"id": "lines", "op": "Sink.DataLake", "params": {"path": lines, "format": "parquet"}},
        {"id": "typed", "op": "Type.Cast", "params": {"casts": {"o_totalprice": "Decimal(18,2)"}}},
        {"id": "open", "op": "Transform.Filter", "params": {"condition": "o_orderstatus <> 'P'"}},
    ]
    edges = [("orders", "open"), ("open", "typed"), ("typed", "lines"), ("typed", "even"), ("even", "sums"), ("sums", "totals")]
    run_graph(spark, nodes, edges, orders=orders)
    whole = aggregate(spark.read.parquet(lines), ["o_orderpriority"], metrics).withColumn("sink", F.lit("lines"))
    both = whole.unionByName(spark.read.parquet(totals).withColumn("sink", F.lit("totals")))
    return both.select("sink", "o_orderpriority", "n", F.col("total").cast("double").alias("total"))
