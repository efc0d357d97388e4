import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from pipekit.operators.aggregate import aggregate, pivot


@pytest.fixture
def sparse(spark):
    data = [("a", "x", 1, 1.5), ("a", "y", 2, None), ("a", "x", 3, 2.5), ("b", "y", None, 4.0), (None, "x", 5, 5.0)]
    return spark.createDataFrame(data, "k string, c string, v bigint, w double")


def test_every_metric(sparse):
    metrics = {op: {"op": op, "col": "v"} for op in ("sum", "mean", "avg", "min", "max", "count", "median")}
    metrics |= {"n": {"op": "count"}, "all": {"op": "count", "col": "*"}, "d": {"op": "count_distinct", "col": "c"}}
    metrics |= {"f": {"op": "first", "col": "v", "order_by": "w"}, "l": {"op": "last", "col": "v", "order_by": "w"}}
    metrics |= {"any": {"op": "first", "col": "c"}, "sd": {"op": "stddev", "col": "v"}, "vr": {"op": "var", "col": "v"}}
    result = {r.k: r.asDict() for r in aggregate(sparse, ["k"], metrics).collect()}
    a = result["a"]
    assert (a["sum"], a["mean"], a["avg"], a["min"], a["max"], a["count"], a["median"]) == (6, 2, 2, 1, 3, 3, 2)
    assert (a["n"], a["all"], a["d"], a["f"], a["l"]) == (3, 3, 2, 1, 3)
    assert (a["sd"], a["vr"]) == (1.0, 1.0)
    assert result["b"]["sum"] is None and result["b"]["count"] == 0 and result["b"]["f"] is None
    assert result[None]["sum"] == 5


def test_global(sparse):
    assert tuple(aggregate(sparse, metrics={"s": {"op": "sum", "col": "v"}, "n": {"op": "count"}}).first()) == (11, 5)
    assert tuple(aggregate(sparse.limit(0), metrics={"n": {"op": "count"}}).first()) == (0,)


def test_spread_median_agrees(table, sparse):
    lines = table("lineitem")
    metrics = {
        "med": {"op": "median", "col": "l_extendedprice"},
        "q": {"op": "median", "col": "l_quantity"},
        "s": {"op": "sum", "col": "l_quantity"},
    }
    for groups in (["l_suppkey"], []):
        plain, spread = (aggregate(lines, groups, metrics, limit) for limit in (None, 0))
        assert plain.columns == spread.columns and rows(plain) == rows(spread)
    metrics = {"m": {"op": "median", "col": "v"}}
    assert rows(aggregate(sparse, ["k"], metrics, 0)) == rows(aggregate(sparse, ["k"], metrics)) == [
        (None, 5.0),
        ("a", 2.0),
        ("b", None),
    ]


def test_rejections(sparse):
    for bad in ({}, {"x": {"op": "mode", "col": "v"}}, {"x": {"op": "sum"}}, {"x": {"op": "sum", "col": "zz"}}):
        with pytest.raises(ValueError):
            aggregate(sparse, ["k"], bad)


def test_combines_before_the_shuffle_and_reads_two_columns(table):
    text = plan(aggregate(table("lineitem"), ["l_returnflag"], {"s": {"op": "sum", "col": "l_quantity"}}))
    assert "partial_sum" in text and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text


def test_pivot(sparse):
    assert rows(pivot(sparse, ["k"], ["c"], ["v"])) == [(None, 5, None), ("a", 4, 2), ("b", None, None)]
    assert rows(pivot(sparse, ["k"], ["c"], ["v"], "count", 0)) == [(None, 1, 0), ("a", 2, 1), ("b", 0, 0)]
    wide = pivot(sparse, ["k"], ["c"], ["v", "w"], "max", 0, pivot_values=["x"])
    assert wide.columns == ["k", "x_v", "x_w"] and rows(wide) == [(None, 5, 5.0), ("a", 3, 2.5), ("b", 0, 0.0)]


def test_pivot_on_two_columns_names_missing_parts(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (1, None, "x", 2)], "k int, c string, d string, v int")
    assert sorted(pivot(df, ["k"], ["c", "d"], ["v"]).columns) == ["a_x", "k", "null_x"]


def test_too_many_pivot_values_are_an_error(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "5")
    try:
        with pytest.raises(Exception, match="pivot"):
            pivot(spark.range(10).withColumn("k", F.lit(1)), ["k"], ["id"], ["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_pivot_tells_labels_apart(spark):
    """Cells are values, not names: what would share a name is an error and never one sum."""
    df = spark.createDataFrame([(1, "a_b", "c", 1), (1, "a", "b_c", 10)], "k int, x string, y string, v int")
    with pytest.raises(ValueError, match="a_b_c"):
        pivot(df, ["k"], ["x", "y"], ["v"])
    apart = pivot(df, ["k"], ["x", "y"], ["v"], pivot_values=[("a_b", "c"), ("a", "b\\_c")])
    assert apart.columns == ["k", "a_b_c", "a_b\\_c"] and rows(apart) == [(1, 1, None)]
    nulls = spark.createDataFrame([(1, None, "z", 1), (1, "null", "z", 10)], "k int, x string, y string, v int")
    for columns in (["x", "y"], ["x"]):
        with pytest.raises(ValueError, match="null"):
            pivot(nulls, ["k"], columns, ["v"])
    fine = pivot(nulls.where("x IS NULL"), ["k"], ["x", "y"], ["v"])
    assert fine.columns == ["k", "null_z"] and rows(fine) == [(1, 1)]


@pytest.mark.parametrize("kind", ["int", "double", "decimal(10,2)"])
def test_medians_have_one_type(spark, kind):
    df = spark.range(9).selectExpr("id % 2 AS g", f"CAST(id AS {kind}) AS v")
    metrics = {"m": {"op": "median", "col": "v"}}
    plain, spread = (aggregate(df, ["g"], metrics, max_group_rows=limit) for limit in (None, 0))
    assert plain.schema["m"].dataType == spread.schema["m"].dataType and rows(plain) == rows(spread)


def test_metrics_on_names_with_dots(spark):
    df = spark.createDataFrame([(1, 2), (1, 4)], "k int, `a.b` int")
    metrics = {"s": {"op": "sum", "col": "a.b"}, "n": {"op": "count", "col": "a.b"}}
    metrics["f"] = {"op": "first", "col": "a.b", "order_by": "a.b"}
    assert rows(aggregate(df, ["k"], metrics)) == [(1, 6, 2, 2)]
