"""Values by their rank in a group, found by counting instead of sorting.

Numbers are taken as 64-bit integers in the same order. A pass counts the rows of each group by their
leading bits, which says where the wanted ranks lie; the next pass counts only rows that share those
bits, by further ones, or by all that are left once the rows are few. Counts are combined in every task
before the shuffle, so that a group of any size sends at most one row for each of its leading bits, and
no row of the table is sorted or written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pipekit.functions.order import with_order_key
from pipekit.operators.keys import match, named
from pipekit.session import saved

# Bits that a pass decides on; most counts of a group are 2 to this power.
BITS = 22
# Rows of the same leading bits that are counted by all further bits at once.
FEW = 1_000_000


def at_ranks(df: DataFrame, keys: Sequence[str], column: str, ranks: Column) -> DataFrame:
    """`keys`, `rank`, `value` and `inside`, a row for each of the group's `ranks`; `inside` is the rank
    among the rows with that value.

    `ranks` is an array of different numbers from 1, made from `__n`, the group's known values; ranks
    beyond them are left out. Each pass is a job, three at most, which leaves a small table: a row for
    each rank of each group.
    """
    groups = [named(k) for k in keys]
    rows = df.select(*groups, named(column).alias("__value")).where("__value IS NOT NULL")
    rows = with_order_key(rows, "__value", "__key")
    left, wanted, few = 64, None, False
    while left:
        above, left = left, 0 if few else max(left - BITS, 0)
        own = rows
        if wanted is not None:
            own = own.withColumn("__above", F.shiftright("__key", above))
            own = match(own, wanted.select(*groups, "__above").distinct(), [*keys, "__above"], "left_semi")
        counts = own.groupBy(*groups, F.shiftright("__key", left).alias("__bits"))
        counts = counts.agg(F.count(F.lit(1)).alias("__rows"), F.min("__value").alias("value"))
        if wanted is None:
            whole = Window.partitionBy(*groups)
            counts = counts.withColumn("__n", F.sum("__rows").over(whole))
            running = F.sum("__rows").over(whole.orderBy("__bits"))
            placed = counts.withColumn("__upto", running).withColumn("__rank", F.explode(ranks)).drop("__n")
            placed = placed.withColumn("__which", F.col("__rank"))
        else:
            counts = counts.withColumn("__above", F.shiftright("__bits", above - left))
            placed = match(counts, wanted, [*keys, "__above"])
            running = F.sum("__rows").over(Window.partitionBy(*groups, "__which").orderBy("__bits"))
            placed = placed.withColumn("__upto", running)
        before = F.col("__upto") - F.col("__rows")
        placed = placed.where((before < F.col("__rank")) & (F.col("__rank") <= F.col("__upto")))
        step = placed.select(
            *groups, "__which", (F.col("__rank") - before).alias("__rank"), F.col("__bits").alias("__above"), "value", "__rows"
        )
        found = saved(step, "ranks")
        wanted = found.drop("value", "__rows")
        few = left > 0 and (found.agg(F.max("__rows")).first()[0] or 0) <= FEW
    return found.select(*groups, F.col("__which").alias("rank"), "value", F.col("__rank").alias("inside"))
