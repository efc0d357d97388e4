"""Joins, aggregates, pivots, sorting and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pipekit.operators.aggregate import aggregate, pivot
from pipekit.operators.joins import join_tables
from pipekit.operators.ordering import head, rank_rows, sample, sample_rows, sort_rank, sort_rows, top_n
from pipekit.queries.registry import Tables, query


def _orders_by_customer(table: Tables) -> DataFrame:
    return table("orders").withColumnRenamed("o_custkey", "c_custkey")


# --- joins ---------------------------------------------------------------------------------


@query(
    "join_aggregate_sort",
    """
    SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY c_mktsegment
    """,
)
def join_aggregate_sort(table: Tables) -> DataFrame:
    joined = join_tables(_orders_by_customer(table), table("customer"), ["c_custkey"])
    metrics = {"n_orders": {"op": "count"}, "total": {"op": "sum", "col": "o_totalprice"}}
    totals = aggregate(joined, ["c_mktsegment"], metrics)
    return sort_rows(totals.withColumn("total", F.round("total", 2)), [("total", "desc")])


@query(
    "join_inner",
    """
    SELECT c_custkey, o_orderkey, o_totalprice, c_name, c_nationkey
    FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def join_inner(table: Tables) -> DataFrame:
    orders = _orders_by_customer(table).select("c_custkey", "o_orderkey", "o_totalprice")
    return join_tables(orders, table("customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])


@query(
    "join_left",
    """
    SELECT c_custkey, c_name, o_orderkey, o_totalprice
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey
    """,
)
def join_left(table: Tables) -> DataFrame:
    large = _orders_by_customer(table).filter("o_totalprice > 400000")
    customers = table("customer").select("c_custkey", "c_name")
    return join_tables(customers, large.select("c_custkey", "o_orderkey", "o_totalprice"), ["c_custkey"], "left")


@query(
    "join_right",
    """
    SELECT c_custkey, o_orderkey, c_name
    FROM (SELECT * FROM orders WHERE o_totalprice > 400000) RIGHT JOIN customer ON o_custkey = c_custkey
    """,
)
def join_right(table: Tables) -> DataFrame:
    large = _orders_by_customer(table).filter("o_totalprice > 400000").select("c_custkey", "o_orderkey")
    return join_tables(large, table("customer").select("c_custkey", "c_name"), ["c_custkey"], "right")


OUTER_SQL = """
    SELECT coalesce(o.k, c.k) AS nationkey, o.n AS customers, c.n AS suppliers
    FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) o
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) c ON o.k = c.k
    """


@query("join_outer", OUTER_SQL)
def join_outer(table: Tables) -> DataFrame:
    count = {"customers": {"op": "count"}}
    rich = table("customer").filter("c_acctbal > 9000").withColumnRenamed("c_nationkey", "nationkey")
    suppliers = table("supplier").withColumnRenamed("s_nationkey", "nationkey")
    return join_tables(
        aggregate(rich, ["nationkey"], count),
        aggregate(suppliers, ["nationkey"], {"suppliers": {"op": "count"}}),
        ["nationkey"],
        "outer",
    )


@query(
    "join_outer_split",
    """
    SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, o_totalprice, l_partkey, l_suppkey
    FROM (SELECT * FROM orders WHERE o_totalprice > 100000)
    FULL JOIN (SELECT * FROM lineitem WHERE l_quantity > 25) ON o_orderkey = l_orderkey
    """,
)
def join_outer_split(table: Tables) -> DataFrame:
    """The way taken when a key is too frequent, forced."""
    orders = table("orders").filter("o_totalprice > 100000").withColumnRenamed("o_orderkey", "orderkey")
    lines = table("lineitem").filter("l_quantity > 25").withColumnRenamed("l_orderkey", "orderkey")
    return join_tables(
        orders.select("orderkey", "o_totalprice"),
        lines.select("orderkey", "l_partkey", "l_suppkey"),
        ["orderkey"],
        "outer",
        max_group_rows=0,
    )


@query(
    "join_semi",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
    """,
)
def join_semi(table: Tables) -> DataFrame:
    urgent = _orders_by_customer(table).filter("o_orderpriority = '1-URGENT'")
    return join_tables(table("customer").select("c_custkey", "c_name"), urgent, ["c_custkey"], "left_semi")


@query(
    "join_anti",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
    """,
)
def join_anti(table: Tables) -> DataFrame:
    urgent = _orders_by_customer(table).filter("o_orderpriority = '1-URGENT'")
    return join_tables(table("customer").select("c_custkey", "c_name"), urgent, ["c_custkey"], "left_anti")


@query(
    "join_suffix",
    """
    SELECT c_custkey AS "key", c_name AS name_cust, c_acctbal AS acctbal_cust,
           s_name AS name_supp, s_acctbal AS acctbal_supp
    FROM customer JOIN supplier ON c_custkey = s_suppkey
    """,
)
def join_suffix(table: Tables) -> DataFrame:
    customers = table("customer").selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS acctbal")
    suppliers = table("supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS acctbal")
    return join_tables(customers, suppliers, ["key"], suffixes=("_cust", "_supp"))


@query(
    "join_null_safe",
    """
    WITH e AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, user_id FROM events),
         l AS (SELECT event_type, user_id, count(*) AS n FROM e WHERE user_id % 2 = 0 GROUP BY ALL),
         r AS (SELECT event_type, count(*) AS total FROM e GROUP BY ALL)
    SELECT l.event_type, user_id, n, total FROM l JOIN r ON l.event_type IS NOT DISTINCT FROM r.event_type
    """,
)
def join_null_safe(table: Tables) -> DataFrame:
    gap = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    events = table("events").select(gap.alias("event_type"), "user_id")
    per_user = aggregate(events.filter("user_id % 2 = 0"), ["event_type", "user_id"], {"n": {"op": "count"}})
    per_type = aggregate(events, ["event_type"], {"total": {"op": "count"}})
    return join_tables(per_user, per_type, ["event_type"], null_safe=True)


@query(
    "join_broadcast_checked",
    """
    SELECT n_nationkey AS nationkey, n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def join_broadcast_checked(table: Tables) -> DataFrame:
    customers = table("customer").select(F.col("c_nationkey").alias("nationkey"), "c_custkey")
    nations = table("nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return join_tables(customers, nations, ["nationkey"], broadcast="right")


# --- aggregates ----------------------------------------------------------------------------


@query(
    "aggregate_sum",
    """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
    """,
)
def aggregate_sum(table: Tables) -> DataFrame:
    lines = table("lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    lines = lines.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    metrics = {"sum_qty": {"op": "sum", "col": "l_quantity"}, "revenue": {"op": "sum", "col": "net"}}
    totals = aggregate(lines, ["l_returnflag", "l_linestatus"], metrics)
    return totals.withColumn("revenue", F.round("revenue", 2))


@query(
    "aggregate_multi",
    """
    SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
           round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd,
           round(var_samp(o_totalprice / 1000), 4) AS var_k, median(o_totalprice) AS med,
           arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
           arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order
    FROM orders GROUP BY ALL
    """,
)
def aggregate_multi(table: Tables) -> DataFrame:
    orders = table("orders").withColumn("k", F.col("o_totalprice") / 1000)
    price = "o_totalprice"
    result = aggregate(
        orders,
        ["o_orderpriority"],
        {
            "n": {"op": "count"},
            "lo": {"op": "min", "col": price},
            "hi": {"op": "max", "col": price},
            "mean": {"op": "mean", "col": price},
            "sd": {"op": "stddev", "col": price},
            "var_k": {"op": "var", "col": "k"},
            "med": {"op": "median", "col": price},
            "first_order": {"op": "first", "col": "o_orderkey", "order_by": "o_orderdate"},
            "last_order": {"op": "last", "col": "o_orderkey", "order_by": "o_orderdate"},
        },
    )
    return result.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "var_k")})


MEDIAN_SQL = "SELECT l_returnflag, median(l_extendedprice) AS med, count(*) AS n FROM lineitem GROUP BY ALL"


@query("aggregate_median_spread", MEDIAN_SQL)
def aggregate_median_spread(table: Tables) -> DataFrame:
    """The way taken when a group is too large for one task, forced."""
    metrics = {"med": {"op": "median", "col": "l_extendedprice"}, "n": {"op": "count"}}
    return aggregate(table("lineitem"), ["l_returnflag"], metrics, max_group_rows=0)


@query(
    "aggregate_global",
    """
    SELECT count(*) AS n, sum(l_quantity) AS qty, max(l_shipdate) AS last_ship,
           round(avg(l_discount), 8) AS mean_discount
    FROM lineitem
    """,
)
def aggregate_global(table: Tables) -> DataFrame:
    result = aggregate(
        table("lineitem"),
        metrics={
            "n": {"op": "count"},
            "qty": {"op": "sum", "col": "l_quantity"},
            "last_ship": {"op": "max", "col": "l_shipdate"},
            "mean_discount": {"op": "avg", "col": "l_discount"},
        },
    )
    return result.withColumn("mean_discount", F.round("mean_discount", 8))


@query(
    "aggregate_distinct",
    """
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts
    FROM lineitem GROUP BY ALL
    """,
)
def aggregate_distinct(table: Tables) -> DataFrame:
    metrics = {
        "orders": {"op": "count_distinct", "col": "l_orderkey"},
        "parts": {"op": "count_distinct", "col": "l_partkey"},
    }
    return aggregate(table("lineitem"), ["l_returnflag"], metrics)


@query("aggregate_approx_distinct", "SELECT l_returnflag, TRUE AS close FROM lineitem GROUP BY ALL")
def aggregate_approx_distinct(table: Tables) -> DataFrame:
    """The estimate must be within 20 % of the exact count."""
    metrics = {
        "estimate": {"op": "approx_count_distinct", "col": "l_orderkey"},
        "truth": {"op": "count_distinct", "col": "l_orderkey"},
    }
    counts = aggregate(table("lineitem"), ["l_returnflag"], metrics)
    return counts.select("l_returnflag", (F.abs(F.col("estimate") / F.col("truth") - 1) < 0.2).alias("close"))


@query(
    "aggregate_null_group",
    """
    SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, count(*) AS n,
           count(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END) AS n_values
    FROM events GROUP BY 1
    """,
)
def aggregate_null_group(table: Tables) -> DataFrame:
    events = table("events").withColumns(
        {
            "event_type": F.when(F.col("event_id") % 7 != 0, F.col("event_type")),
            "value": F.when(F.col("event_id") % 5 != 0, F.col("value")),
        }
    )
    return aggregate(events, ["event_type"], {"n": {"op": "count"}, "n_values": {"op": "count", "col": "value"}})


# --- pivots --------------------------------------------------------------------------------


@query(
    "pivot_status",
    """
    SELECT o_orderpriority,
           round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS "F",
           round(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0), 2) AS "O",
           round(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0), 2) AS "P"
    FROM orders GROUP BY ALL
    """,
)
def pivot_status(table: Tables) -> DataFrame:
    result = pivot(
        table("orders"), ["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"], fill_value=0, pivot_values=["F", "O", "P"]
    )
    return result.withColumns({c: F.round(c, 2) for c in "FOP"})


@query(
    "pivot_multi_value",
    """
    SELECT o_orderpriority,
           max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS "F_o_totalprice",
           max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS "F_o_orderkey",
           max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS "O_o_totalprice",
           max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS "O_o_orderkey",
           max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS "P_o_totalprice",
           max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS "P_o_orderkey"
    FROM orders GROUP BY ALL
    """,
)
def pivot_multi_value(table: Tables) -> DataFrame:
    """The pivot values are found by a first job."""
    return pivot(table("orders"), ["o_orderpriority"], ["o_orderstatus"], ["o_totalprice", "o_orderkey"], "max")


@query(
    "pivot_labels",
    """
    SELECT user_id % 10 AS grp,
           count(*) FILTER (event_id % 2 = 0 AND event_id % 3 = 0) AS "a_b_c",
           count(*) FILTER (event_id % 2 = 0 AND event_id % 3 > 0) AS "a_b_d_e",
           count(*) FILTER (event_id % 2 = 1 AND event_id % 3 = 0) AS "a_c",
           count(*) FILTER (event_id % 2 = 1 AND event_id % 3 > 0) AS "a_d_e"
    FROM events GROUP BY ALL
    """,
)
def pivot_labels(table: Tables) -> DataFrame:
    """Labels that contain the character they are joined by."""
    events = table("events").select(
        (F.col("user_id") % 10).alias("grp"),
        F.when(F.col("event_id") % 2 == 0, "a_b").otherwise("a").alias("one"),
        F.when(F.col("event_id") % 3 == 0, "c").otherwise("d_e").alias("two"),
        "event_id",
    )
    return pivot(events, ["grp"], ["one", "two"], ["event_id"], "count", fill_value=0)


@query(
    "pivot_two_columns",
    """
    SELECT l_linenumber,
           count(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 END) AS "A_F",
           count(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 1 END) AS "A_O",
           count(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 1 END) AS "N_F",
           count(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 1 END) AS "N_O",
           count(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 END) AS "R_F",
           count(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 END) AS "R_O"
    FROM lineitem GROUP BY ALL
    """,
)
def pivot_two_columns(table: Tables) -> DataFrame:
    flags = ["l_returnflag", "l_linestatus"]
    return pivot(table("lineitem"), ["l_linenumber"], flags, ["l_orderkey"], "count", fill_value=0)


# --- sorting and ranking -------------------------------------------------------------------


@query("sort_rows", "SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate FROM lineitem ORDER BY l_shipdate DESC")
def sort_all(table: Tables) -> DataFrame:
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    return sort_rank(lines, [{"col": "l_shipdate", "dir": "desc"}])


@query(
    "sort_top_k",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100
    """,
)
def sort_top_k(table: Tables) -> DataFrame:
    orders = table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sort_rank(orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")], top_n_rows=100)


RANKED_SQL = """
    SELECT o_orderkey, o_custkey, o_totalprice,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
    FROM orders
    """


def _ranked(table: Tables, **options) -> DataFrame:
    orders = table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rank_rows(orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")], ["o_custkey"], **options)


@query("rank_per_group", RANKED_SQL)
def rank_per_group(table: Tables) -> DataFrame:
    return _ranked(table)


@query("rank_per_group_spread", RANKED_SQL)
def rank_per_group_spread(table: Tables) -> DataFrame:
    """The way taken when a group is too large for one task, forced."""
    return _ranked(table, max_group_rows=0)


@query(
    "rank_ties",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity,
           rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS place
    FROM lineitem
    """,
)
def rank_ties(table: Tables) -> DataFrame:
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return rank_rows(lines, [("l_quantity", "desc")], ["l_suppkey"], "rank", "place", max_group_rows=0)


@query(
    "rank_dense",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity,
           dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS place
    FROM lineitem
    """,
)
def rank_dense(table: Tables) -> DataFrame:
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    ranked = rank_rows(lines, [("l_quantity", "desc")], ["l_returnflag"], "dense_rank", "place", max_group_rows=0)
    return ranked.drop("l_returnflag")


@query(
    "top_n_per_group",
    """
    SELECT * FROM (
        SELECT c_custkey, c_nationkey, c_acctbal,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank
        FROM customer) WHERE rank <= 3
    """,
)
def top_n_per_group(table: Tables) -> DataFrame:
    customers = table("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return sort_rank(customers, [("c_acctbal", "desc"), ("c_custkey", "asc")], ["c_nationkey"], 3)


@query(
    "top_n_with_ties",
    """
    SELECT * FROM (
        SELECT l_orderkey, l_partkey, l_suppkey, l_quantity,
               rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS rank
        FROM lineitem) WHERE rank <= 5
    """,
)
def top_n_with_ties(table: Tables) -> DataFrame:
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return top_n(lines, [("l_quantity", "desc")], 5, ["l_suppkey"], "rank")


GLOBAL_SQL = """
    SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey DESC) AS rank FROM orders
    """


@query("global_rank", GLOBAL_SQL)
def global_rank(table: Tables) -> DataFrame:
    orders = table("orders").select("o_orderkey", "o_orderdate")
    return sort_rank(orders, ["o_orderdate", ("o_orderkey", "desc")], rank_col="rank")


@query("global_rank_spread", GLOBAL_SQL)
def global_rank_spread(table: Tables) -> DataFrame:
    """The way taken when the table is too large for one task, forced."""
    orders = table("orders").select("o_orderkey", "o_orderdate")
    return rank_rows(orders, ["o_orderdate", ("o_orderkey", "desc")], max_group_rows=0)


@query("sample_head", "SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 1000)")
def sample_head(table: Tables) -> DataFrame:
    return aggregate(head(table("events"), 1000), metrics={"n": {"op": "count"}})


@query("sample_fraction", "SELECT TRUE AS fair, count(DISTINCT event_type) AS kinds FROM events")
def sample_fraction(table: Tables) -> DataFrame:
    """A tenth of the rows, give or take, with every kind of event among them."""
    events = table("events")
    picked = sample(events, 0.1, seed=7).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"))
    total = events.agg(F.count(F.lit(1)).alias("total")).scalar()
    return picked.select(F.col("n").between(total * 0.05, total * 0.15).alias("fair"), "kinds")


@query(
    "sample_exact",
    """
    SELECT 'all' AS kind, least(count(*), 5000) AS n, least(count(*), 5000) AS kinds, TRUE AS fair FROM events
    UNION ALL SELECT event_type, least(count(*), 300), 1, TRUE FROM events GROUP BY event_type
    """,
)
def sample_exact(table: Tables) -> DataFrame:
    """So many rows, all different as in the table, and so many of each kind; means close to the table's."""
    events = table("events")
    whole, spread = events.agg(F.avg("user_id").alias("m"), F.stddev("user_id").alias("s")).first()
    rows = sample_rows(events, 5000, seed=3).agg(
        F.lit("all").alias("kind"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("event_id").alias("kinds"),
        (F.abs(F.avg("user_id") - whole) < spread / 10).alias("fair"),
    )
    each = sample_rows(events, 300, ["event_type"], seed=3).groupBy(F.col("event_type").alias("kind"))
    near = F.abs(F.avg("user_id") - whole) < spread / 2
    return rows.unionByName(each.agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("kinds"), near.alias("fair")))
