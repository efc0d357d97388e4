"""Order keys, values at ranks and places against sorting."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from pipekit.functions.order import with_order_key
from pipekit.operators import selection
from pipekit.operators.aggregate import aggregate
from pipekit.operators.ordering import numbered, rank_rows


def odd_doubles():
    r = random.Random(1)
    odd = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0)]
    odd += [math.nextafter(math.inf, 0), -math.nextafter(math.inf, 0), 1e16, 1e16 + 2]
    odd += [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(2000)]
    for e in range(-1074, 1024, 3):
        odd += [2.0**e, -(2.0**e), math.nextafter(2.0**e, 0), math.nextafter(2.0**e, math.inf)]
    return odd


@pytest.mark.parametrize("kind", ["double", "float"])
def test_keys_of_doubles_compare_as_they_do(spark, kind):
    df = spark.createDataFrame([(v,) for v in [*odd_doubles(), None]], "v double").select(F.col("v").cast(kind))
    found = with_order_key(df, "v", "k").collect()
    assert all((r.v is None) == (r.k is None) for r in found)
    by = sorted(((math.isnan(r.v), 0.0 if math.isnan(r.v) else r.v), r.k) for r in found if r.v is not None)
    for (a, x), (b, y) in zip(by, by[1:]):
        assert x <= y and (x == y) == (a == b)


def test_keys_of_other_numbers(spark):
    df = spark.createDataFrame([(-(2**63), -1), (2**63 - 1, 5), (None, None)], "a long, b int")
    df = df.withColumn("c", F.expr("CAST(b * 1.25 AS decimal(18,3))"))
    assert rows(with_order_key(df, "a", "k"), "k") == [(None,), (-(2**63),), (2**63 - 1,)]
    assert rows(with_order_key(df, "c", "k"), "k") == [(None,), (-1250,), (6250,)]
    with pytest.raises(ValueError, match="decimal"):
        with_order_key(df.withColumn("d", F.col("c").cast("decimal(30,2)")), "d", "k")


@pytest.mark.parametrize("few", [selection.FEW, 0])
@pytest.mark.parametrize("kind", ["double", "int", "decimal(12,2)", "float"])
def test_medians_with_a_hot_group(spark, monkeypatch, few, kind):
    monkeypatch.setattr(selection, "FEW", few)
    df = spark.range(0, 6000, 1, 7).selectExpr(
        "if(id % 3 = 0, 'hot', if(id % 11 = 0, NULL, CAST(id % 40 AS STRING))) AS g",
        f"CAST(if(id % 13 = 0, NULL, pmod(xxhash64(id), 4001) / 7 - 200) AS {kind}) AS v",
    )
    df = df.union(spark.sql(f"SELECT 'none' AS g, CAST(NULL AS {kind}) AS v"))
    metrics = {"m": {"op": "median", "col": "v"}, "n": {"op": "count"}}
    for groups in (["g"], []):
        plain, spread = (aggregate(df, groups, metrics, limit) for limit in (None, 0))
        assert plain.schema == spread.schema and rows(plain) == rows(spread)
    empty = aggregate(df.limit(0), ["g"], metrics, 0)
    assert empty.count() == 0


def test_a_median_sorts_no_rows(table):
    lines = table("lineitem").select("l_returnflag", "l_extendedprice")
    text = plan(selection.at_ranks(lines, ["l_returnflag"], "l_extendedprice", F.array(F.lit(1))))
    assert "Sort" not in text and "lineitem" not in text  # what is left is a small table


def test_single_values_of_extreme_size(spark):
    df = spark.createDataFrame([("a", 1.7e308), ("a", 1.7e308), ("a", 1e308), ("b", -0.0), ("c", math.nan)], "g string, v double")
    metrics = {"m": {"op": "median", "col": "v"}}
    assert str(rows(aggregate(df, ["g"], metrics, 0))) == str(rows(aggregate(df, ["g"], metrics)))


def test_places_and_sums_before(spark):
    df = spark.range(0, 500, 1, 6).selectExpr("pmod(xxhash64(id), 1000003) AS k", "id % 5 AS w", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(numbered(df, [F.col("k").asc()], "w"), "k", "w", "__place", "__before")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = 0
    for i, (k, w) in enumerate(rows(df, "k", "w")):
        assert found[i] == (k, w, i, before)
        before += w
    assert numbered(df.limit(0), [F.col("k").asc()]).count() == 0


def test_ranks_use_no_python(table):
    orders = table("orders").select("o_orderkey", "o_orderdate", "o_custkey")
    for method in ("row_number", "rank", "dense_rank"):
        text = plan(rank_rows(orders, ["o_orderdate"], ["o_custkey"], method, max_group_rows=0))
        assert "InArrow" not in text and "Python" not in text
