"""Sorting, ranking and top-N.

A rank within groups is a window, which hands each group to one task. A rank of the whole table, and
one of groups that are known or counted to be very large, is a range sort instead, written once: a
row's place is its index in its file and the rows of the files before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pipekit.functions.types import as_text
from pipekit.operators.keys import first_rows, hashable, largest_group, match, named, require, row_hash
from pipekit.operators.selection import at_ranks
from pipekit.session import fresh_path

RANK_METHODS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}

# A top-N this small prunes every map task to N rows per group, however large the groups are.
PRUNED_TOP_N = 100
# Most rows that every map task may send to the one task of a global top-N.
GATHERED_TOP_N = 1_000

Order = str | tuple[str, str] | Mapping[str, str]


def order_columns(order_by: Sequence[Order]) -> list[tuple[str, str]]:
    """`[{"col", "dir"}]`, `(name, dir)` pairs or plain names as `(name, dir)` pairs."""
    pairs = []
    for item in order_by:
        if isinstance(item, str):
            pair = (item, "asc")
        elif isinstance(item, Mapping):
            pair = (item["col"], item.get("dir", "asc"))
        else:
            pair = (item[0], item[1])
        if pair[1] not in ("asc", "desc"):
            raise ValueError(f"dir must be 'asc' or 'desc', not {pair[1]!r}")
        pairs.append(pair)
    if not pairs:
        raise ValueError("order_by needs at least one column")
    return pairs


def sort_keys(order_by: Sequence[Order]) -> list[Column]:
    """Sort columns with nulls last in both directions."""
    return [
        named(name).desc_nulls_last() if way == "desc" else named(name).asc_nulls_last()
        for name, way in order_columns(order_by)
    ]


def _spread_sort(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Global sort that also spreads rows with equal keys over several range partitions.

    Equal keys are told apart by a hash of the row, and copies of a row by the input partition
    they came from (which, unlike a row number, is the same when a lost task is run again).
    """
    tagged = df.withColumns({"__hash": row_hash(df), "__from": F.spark_partition_id()})
    return tagged.orderBy(*keys, "__hash", "__from").drop("__hash", "__from")


def sort_rows(df: DataFrame, order_by: Sequence[Order]) -> DataFrame:
    """Sort the whole table, nulls last; rows with equal keys come in a repeatable order."""
    require(df, [name for name, _ in order_columns(order_by)])
    return _spread_sort(df, sort_keys(order_by))


def rank_rows(
    df: DataFrame,
    order_by: Sequence[Order],
    partition_by: Sequence[str] = (),
    method: str = "row_number",
    rank_col: str = "rank",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Add the rank of each row in its group (or in the whole table).

    `method` is `row_number`, `rank` or `dense_rank`. Without groups the table is range-sorted and
    written once, when this is called. With groups, `max_group_rows` asks to count them first; if
    one has more rows the same is done, with the same result.
    """
    if method not in RANK_METHODS:
        raise ValueError(f"method must be one of {sorted(RANK_METHODS)}, not {method!r}")
    require(df, [*partition_by, *[name for name, _ in order_columns(order_by)]])
    if partition_by and (max_group_rows is None or largest_group(df, partition_by) <= max_group_rows):
        return df.withColumn(rank_col, _window_rank(df, order_by, partition_by, method))
    return _spread_rank(df, order_by, list(partition_by), method, rank_col)


def _window_rank(df: DataFrame, order_by: Sequence[Order], partition_by: Sequence[str], method: str) -> Column:
    ties = [row_hash(df)] if method == "row_number" else []
    window = Window.partitionBy(*[named(p) for p in partition_by]).orderBy(*sort_keys(order_by), *ties)
    return RANK_METHODS[method]().over(window).cast("bigint")


def numbered(df: DataFrame, keys: Sequence[Column], weight: str | None = None) -> DataFrame:
    """The rows with `__place`, their number from 0 in the order of `keys`; with `weight`, with
    `__before` too, the sum of that column over all rows before.

    The table is range-sorted and written once, when this is called. Each file is one range, so a
    row's place is its index in the file, which Spark tells, and the rows of the files before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "sorted")
    _spread_sort(df, keys).write.parquet(path)
    at = F.col("_metadata")
    slot = F.regexp_extract(at["file_name"], r"^part-(\d+)", 1).cast("int")
    rows = spark.read.schema(df.schema).parquet(path)
    rows = rows.select("*", slot.alias("__slot"), at["row_index"].alias("__row"))
    weights = F.sum(named(weight)) if weight else F.lit(0)
    sizes = rows.groupBy("__slot").agg(F.count(F.lit(1)).alias("n"), weights.cast("long").alias("w"))
    # One row for each file.
    found, places, before = sorted((r["__slot"], r["n"], r["w"]) for r in sizes.collect()), 0, 0
    starts = []
    for number, n, w in found:
        starts.append((number, places, before))
        places, before = places + n, before + w
    offsets = F.broadcast(spark.createDataFrame(starts, "__slot int, __first long, __sum long"))
    rows = rows.join(offsets, "__slot").withColumn("__place", F.col("__first") + F.col("__row"))
    if weight:
        earlier = Window.partitionBy("__slot").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(named(weight)).over(earlier), F.lit(0))
        rows = rows.withColumn("__before", F.col("__sum") + inside)
    return rows.drop("__slot", "__row", "__first", "__sum")


def _spread_rank(
    df: DataFrame, order_by: Sequence[Order], partition_by: list[str], method: str, rank_col: str
) -> DataFrame:
    """Ranks from places in a range sort by group and order.

    A row number is a row's place after the first of its group. Ties need no sorted rows: their
    different values are counted, these counts sorted, and each row gets the rank of its values.
    """
    names = [name for name, _ in order_columns(order_by)]
    groups, keys = [named(p).asc_nulls_last() for p in partition_by], sort_keys(order_by)
    if method == "row_number":
        rows, counted = numbered(df, [*groups, *keys]), "__place"
    else:
        values = [*partition_by, *[n for n in dict.fromkeys(names) if n not in partition_by]]
        ties = df.groupBy(*[named(v) for v in values]).agg(F.count(F.lit(1)).alias("__rows"))
        weight, counted = ("__rows", "__before") if method == "rank" else (None, "__place")
        rows = numbered(ties, [*groups, *keys], weight).select(*[named(v) for v in values], counted)
    rank = F.col(counted) + 1
    if partition_by:
        first = rows.groupBy(*[named(p) for p in partition_by]).agg(F.min(counted).alias("__start"))
        rows = match(rows, first, partition_by)
        rank = rank - F.col("__start")
    rows = rows.withColumn("__rank", rank)
    if method != "row_number":
        rows = match(df, rows.select(*[named(v) for v in values], "__rank"), values)
    return rows.select(*[named(c) for c in df.columns], F.col("__rank").alias(rank_col))


def top_n(
    df: DataFrame,
    order_by: Sequence[Order],
    n: int,
    partition_by: Sequence[str] = (),
    method: str = "row_number",
    rank_col: str = "rank",
    max_group_rows: int | None = None,
) -> DataFrame:
    """The first `n` rows of the table, or of each group with their rank.

    `rank` and `dense_rank` keep all rows tied with the last one. A small `n` by row number is
    pruned in every map task before the shuffle; anything else goes by `rank_rows`.
    """
    if n < 1:
        raise ValueError(f"n must be positive, not {n}")
    require(df, [*partition_by, *[name for name, _ in order_columns(order_by)]])
    if method == "row_number" and not partition_by and n <= GATHERED_TOP_N:
        return df.orderBy(*sort_keys(order_by), row_hash(df)).limit(n)
    if method == "row_number" and n <= PRUNED_TOP_N:
        max_group_rows = None
    ranked = rank_rows(df, order_by, partition_by, method, rank_col, max_group_rows)
    best = ranked.filter(named(rank_col) <= n)
    return best if partition_by else sort_rows(best.drop(rank_col), order_by)


def sort_rank(
    df: DataFrame,
    order_by: Sequence[Order],
    partition_by: Sequence[str] = (),
    top_n_rows: int | None = None,
    rank_col: str | None = None,
    method: str = "row_number",
) -> DataFrame:
    """Sort, rank or cut to the top rows, by which arguments are given.

    Only `order_by`: a sorted table. With `partition_by` or `rank_col`: a rank column. With
    `top_n_rows`: only the first rows, of each group if there are groups.
    """
    if top_n_rows is not None:
        return top_n(df, order_by, top_n_rows, partition_by, method, rank_col or "rank")
    if partition_by or rank_col:
        return rank_rows(df, order_by, partition_by, method, rank_col or "rank")
    return sort_rows(df, order_by)


def head(df: DataFrame, n: int) -> DataFrame:
    """Any `n` rows, whichever are read first; `GATHERED_ROWS` at most, as one task gathers them."""
    return first_rows(df, n)


def sample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """An unbiased random sample of about `fraction` of the rows."""
    return df.sample(fraction=fraction, seed=seed)


def sample_rows(df: DataFrame, n: int, strata: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """A random sample of exactly `n` rows, or of `n` from each group of `strata`; all, if there are no more.

    The rows with the least hashes, the same for a seed however the table is partitioned. A small
    sample is cut in every task; for a large one, or one by strata, the n-th hash of each group is found by
    counting, when this is called, and rows up to it are kept where they are.
    """
    if n < 0:
        raise ValueError(f"n must not be negative, but is {n}")
    require(df, strata)
    known = [f.name for f in df.schema if hashable(f.dataType)]
    parts = [part for c in known for part in (named(c).isNull(), named(c))]
    # Maps and variants have no hash; rows alike in all other columns are told apart by them as text.
    parts += [F.expr(as_text(f.name, f.dataType)) for f in df.schema if f.name not in known]
    tagged = df.withColumns({f"__hash{i}": F.xxhash64(F.lit(seed), F.lit(i), *parts) for i in (0, 1)})
    if not strata and n <= GATHERED_TOP_N:
        return tagged.orderBy("__hash0", "__hash1").limit(n).drop("__hash0", "__hash1")
    groups = [named(g) for g in strata]
    limits = at_ranks(tagged, strata, "__hash0", F.array(F.least(F.col("__n"), F.lit(max(n, 1)))))
    limits = limits.select(*groups, F.col("value").alias("__last"), F.col("inside").alias("__more"))
    if n == 0 or limits.isEmpty():
        return df.limit(0)
    if strata:
        placed = match(tagged, limits, strata)
    else:
        last = limits.first()
        placed = tagged.withColumns({"__last": F.lit(last["__last"]), "__more": F.lit(last["__more"])})
    below = placed.where("__hash0 < __last").select(*[named(c) for c in df.columns])
    # Rows of the last hash are copies of one row, as a rule: counted, and as many given out as are due.
    row = F.struct(*[named(c) for c in df.columns]).alias("__row")
    equal = placed.where("__hash0 = __last").groupBy(*groups, "__hash1")
    equal = equal.agg(F.first(row).alias("__row"), F.first("__more").alias("__more"), F.count(F.lit(1)).alias("__copies"))
    before = Window.partitionBy(*groups).orderBy("__hash1").rowsBetween(Window.unboundedPreceding, -1)
    due = F.col("__more") - F.coalesce(F.sum("__copies").over(before), F.lit(0))
    equal = equal.withColumn("__due", F.least(due, F.col("__copies"))).where("__due > 0")
    equal = equal.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__due"))))
    return below.unionByName(equal.select("__row.*"))
