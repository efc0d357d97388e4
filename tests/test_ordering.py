import os
import pathlib
import random
import subprocess
import sys

import pytest
from pyspark.sql import Window, functions as F

from conftest import final_plan, plan, rows
from pipekit.operators import ordering
from pipekit.operators.ordering import rank_rows, sort_rank, sort_rows, top_n


@pytest.fixture(scope="module")
def scores(spark):
    """One group and one score hold a third of the rows each; a third are copies; some nulls."""
    rng = random.Random(3)
    data = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        score = 5 if rng.random() < 0.33 else rng.choice([None, *range(10)])
        data.append((group, score, "copy" if i % 3 == 1 else f"n{i}"))
    return spark.createDataFrame(data, "g string, s bigint, name string").repartition(7).cache()


def brute(df, way, method):
    """Ranks per group of sorted scores, nulls last."""
    found = {}
    for g, s, _ in df.collect():
        found.setdefault(g, []).append(s)
    result = []
    for g, values in found.items():
        known = sorted((v for v in values if v is not None), reverse=way == "desc")
        ordered = known + [None] * (len(values) - len(known))
        distinct = list(dict.fromkeys(ordered))
        for i, v in enumerate(ordered):
            rank = {"row_number": i + 1, "rank": ordered.index(v) + 1, "dense_rank": distinct.index(v) + 1}[method]
            result.append((g, v, rank))
    return sorted(map(str, result))


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("way", ["asc", "desc"])
@pytest.mark.parametrize("method", ["row_number", "rank", "dense_rank"])
def test_rank_in_groups(scores, method, way, limit):
    ranked = rank_rows(scores, [("s", way)], ["g"], method, max_group_rows=limit)
    assert ranked.columns == ["g", "s", "name", "rank"]
    assert sorted(map(str, rows(ranked, "g", "s", "rank"))) == brute(scores, way, method)
    assert ranked.select("g", "s", "name").exceptAll(scores).isEmpty()


@pytest.mark.parametrize("method", ["row_number", "rank", "dense_rank"])
def test_global_rank(scores, method):
    whole = scores.withColumn("g", F.lit("all"))
    ranked = rank_rows(whole, [("s", "desc")], method=method, max_group_rows=0)
    assert sorted(map(str, rows(ranked, "g", "s", "rank"))) == brute(whole, "desc", method)


def test_both_ways_order_ties_alike(scores):
    unique = scores.dropDuplicates()
    plain, spread = (rank_rows(unique, ["s"], ["g"], max_group_rows=limit) for limit in (None, 0))
    assert plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()


def test_large_groups_leave_the_window(scores):
    assert "Window [row_number()" in plan(rank_rows(scores, ["s"], ["g"], max_group_rows=1000))
    assert "Window [row_number()" not in plan(rank_rows(scores, ["s"], ["g"], max_group_rows=900))


def test_sort_spreads_ties_and_copies(spark, scores):
    """No range partition holds all rows of the score, or all copies, that a third of the rows are."""
    same = scores.withColumns({"s": F.lit(1), "g": F.lit("x"), "name": F.lit("copy")})
    sizes = sort_rows(same, ["s"]).groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(r["count"] for r in sizes.collect()) < 0.6 * same.count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sort_puts_nulls_last_both_ways(scores):
    for way in ("asc", "desc"):
        values = [r.s for r in sort_rank(scores, [{"col": "s", "dir": way}]).collect()]
        known = [v for v in values if v is not None]
        assert values[len(known) :] == [None] * (len(values) - len(known))
        assert known == sorted(known, reverse=way == "desc")


def test_top_n_in_groups_is_pruned_before_the_shuffle(scores):
    best = sort_rank(scores, [("s", "desc")], ["g"], 3)
    assert "WindowGroupLimit" in plan(best)
    assert {r.g: r["count"] for r in best.groupBy("g").count().collect()} == {"hot": 3, "a": 3, "b": 3, None: 3}
    assert best.agg(F.min("s")).first()[0] == 9


def test_top_n_of_the_table(scores):
    best = sort_rank(scores, [("s", "desc")], top_n_rows=10)
    assert "TakeOrderedAndProject" in plan(best)
    assert [r.s for r in best.collect()] == [9] * 10


def test_a_large_top_n_is_ranked(scores, monkeypatch):
    monkeypatch.setattr(ordering, "GATHERED_TOP_N", 10)
    wanted = sorted((r.s for r in scores.collect() if r.s is not None), reverse=True)[:50]
    assert [r.s for r in top_n(scores, [("s", "desc")], 50, max_group_rows=0).collect()] == wanted


def test_top_n_with_ties(scores):
    best = top_n(scores, [("s", "desc")], 1, ["g"], "rank", max_group_rows=0)
    assert rows(best.select("rank").distinct()) == [(1,)] and best.count() == scores.filter("s = 9").count()


def test_rejections(scores):
    for call in (
        lambda: sort_rows(scores, []),
        lambda: sort_rows(scores, [("s", "up")]),
        lambda: sort_rows(scores, ["zz"]),
        lambda: rank_rows(scores, ["s"], method="ntile"),
        lambda: top_n(scores, ["s"], 0),
    ):
        with pytest.raises(ValueError):
            call()


def test_samples(table):
    events = table("events")
    assert ordering.head(events, 10).count() == 10
    assert ordering.sample(events, 0.5, 1).count() == ordering.sample(events, 0.5, 1).count()


def test_global_rank_moves_no_table_to_one_task(table):
    orders = table("orders").select("o_orderkey", "o_orderdate")
    text = final_plan(rank_rows(orders, ["o_orderdate"], max_group_rows=0))
    assert "SinglePartition" not in text and "SinglePartition" not in final_plan(rank_rows(orders, ["o_orderdate"]))


@pytest.mark.parametrize("method", ["row_number", "rank", "dense_rank"])
@pytest.mark.parametrize("groups", [[], ["g"], ["g", "h"]])
def test_spread_ranks_over_many_sorted_parts(spark, method, groups):
    """Groups and ties that begin, end and go on across the parts of the sort, and nulls."""
    df = spark.range(2000).selectExpr(
        "if(id % 97 = 0, NULL, CAST(floor(id / 300) AS INT)) AS g",
        "if(id % 5 = 0, NULL, 'x') AS h",
        "if(id < 900, 1, id % 7) AS s",
        "id",
    )
    order = ["s", "id"] if method == "row_number" else ["s"]
    window = Window.partitionBy(*groups).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    want = rows(df.select("id", getattr(F, method)().over(window).alias("rank")))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(rank_rows(df, order, groups, method, max_group_rows=0), "id", "rank") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("gathered", [ordering.GATHERED_TOP_N, 0])
def test_samples_of_exact_size(spark, monkeypatch, gathered):
    """The same rows for a seed, whatever the partitions; copies, nulls and maps."""
    monkeypatch.setattr(ordering, "GATHERED_TOP_N", gathered)
    df = spark.range(3000).selectExpr(
        "if(id < 1000, NULL, id) AS a", "if(id < 1000, 'hot', CAST(id % 3 AS STRING)) AS g", "map('k', id div 1001) AS m"
    )
    text = lambda found: sorted(str(r) for r in found.collect())
    for n in (0, 1, 500, 2999, 3000, 4000):
        one = ordering.sample_rows(df.repartition(3), n, seed=5)
        assert one.dtypes == df.dtypes and one.count() == min(n, 3000)
        assert text(one) == text(ordering.sample_rows(df.repartition(8, "a"), n, seed=5))
    each = ordering.sample_rows(df, 700, ["g"], seed=5)
    sizes = {"hot": 700, **{str(i): 667 for i in range(3)}}
    assert {r.g: r["count"] for r in each.groupBy("g").count().collect()} == {**sizes, "0": 666, "1": 667, "2": 667}
    known = [r.a for r in ordering.sample_rows(df, 600, seed=5).collect() if r.a is not None]
    assert len(set(known)) == len(known) and known != [r.a for r in ordering.sample_rows(df, 600, seed=6).collect() if r.a]
    assert ordering.sample_rows(df.limit(0), 10, ["g"]).count() == 0


def test_heads_are_bounded(table):
    with pytest.raises(ValueError, match="too many"):
        ordering.head(table("events"), 2_000_000)


def test_workers_need_not_import_the_library(tmp_path):
    """A driver that finds the package by its own path only, as a notebook might."""
    root = str(pathlib.Path(ordering.__file__).parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pipekit.operators.ordering import rank_rows
from pipekit.session import session
spark = session("w", "local[1]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {tmp_path.as_uri()!r}}})
print(rank_rows(spark.range(5), [("id", "desc")]).where("rank = 1").first().id)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "4", done.stderr[-2000:]
