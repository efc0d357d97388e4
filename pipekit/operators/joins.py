"""Equi-joins on same-named columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pipekit.operators.keys import largest_group, named, require

# Accepted join kinds and Spark's name for each.
JOIN_KINDS = {
    "inner": "inner",
    "left": "left_outer",
    "right": "right_outer",
    "outer": "full_outer",
    "left_semi": "left_semi",
    "left_anti": "left_anti",
}

# Rows a key may keep on the right side of a semi or anti join.
KEY_PARTS = 16

# Largest side that `broadcast="right"` accepts, in rows and in bytes of their JSON text.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def join_tables(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    suffixes: Sequence[str] = ("_x", "_y"),
    null_safe: bool = False,
    broadcast: str | None = None,
    max_group_rows: int | None = None,
    reshuffle: bool = False,
    right_unique: bool = False,
) -> DataFrame:
    """Join on the columns `on`, present in both tables; other shared names get `suffixes`.

    The result has the key columns once, then the left and the right columns. Null keys match
    nothing unless `null_safe`. `broadcast="right"` asks to ship the right side of an inner or
    left join whole; its rows and bytes are measured first, in a job that stops at the limits
    `BROADCAST_ROWS` and `BROADCAST_BYTES`, beyond which it is not shipped.

    Adaptive execution splits a hot key on either side of an inner join and on the left side
    of a left join, but not on the other side of an outer join. There `max_group_rows` asks to
    count the key frequencies, in a job of its own; if one is larger, the join runs as an inner
    join plus the unmatched rows, with the same result.

    A semi or anti join reduces the right side to a few rows of each key before the join
    shuffles it; `right_unique=True` says that there is only one, which saves that shuffle.

    A side that already lies by the join keys (an aggregate on them, a bucketed table) is joined
    where it lies, which saves a shuffle but leaves hot keys whole. `reshuffle=True` shuffles
    both sides for this join, so that they can be split.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"how must be one of {sorted(JOIN_KINDS)}, not {how!r}")
    if not on:
        raise ValueError("a join needs at least one key column")
    require(left, on)
    require(right, on)

    if broadcast not in (None, "right"):
        raise ValueError(f"broadcast must be 'right' or None, not {broadcast!r}")
    if broadcast and how not in ("inner", "left"):
        raise ValueError(f"the right side of a {how} join cannot be broadcast here")

    if how in ("left_semi", "left_anti"):
        return _matching(left, right, on, how, _null_safe if null_safe else _plain_equal, right_unique)

    equal = _null_safe if null_safe else _not_null if reshuffle else _plain_equal
    left, right = _suffixed(left, right, on, suffixes)
    if broadcast and _is_small(right):
        right = F.broadcast(right)

    if how != "inner" and max_group_rows is not None and not left.isStreaming and not right.isStreaming:
        fixed_sides = {"left": [right], "right": [left], "outer": [left, right]}[how]
        if any(largest_group(side, on) > max_group_rows for side in fixed_sides):
            return _split_outer(left, right, on, how, equal)
    return _plain(left, right, on, how, equal)


def _matching(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, equal: Equal, unique: bool = False
) -> DataFrame:
    """Semi or anti join, with a hot right key reduced to a few rows before the shuffle.

    Not to one row: distinct keys would already lie where the join wants them, and adaptive
    execution splits a hot left key only if both sides are shuffled for the join itself.
    """
    keys = right.select(*[named(k).alias(f"__right_{k}") for k in on])
    if unique:
        return left.join(keys, _condition(on, equal), how)
    parts = keys.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(KEY_PARTS))).distinct()
    return left.join(parts.drop("__part"), _condition(on, equal), how)


def _is_small(df: DataFrame) -> bool:
    """Whether the table may be shipped whole, from its number of rows and bytes."""
    # Rows first, from few of them; bytes only of a table that has no more.
    if df.select(F.lit(1)).limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return False
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def _suffixed(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    names = left.columns + [c for c in right.columns if c not in on]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"suffixes {list(suffixes)} leave repeated columns {repeated}")
    return left, right


Equal = Callable[[Column, Column], Column]


def _plain_equal(key: Column, other: Column) -> Column:
    return key == other


def _null_safe(key: Column, other: Column) -> Column:
    return key.eqNullSafe(other)


def _not_null(key: Column, other: Column) -> Column:
    """The same as plain equality, in a form for which Spark always shuffles by itself."""
    return key.eqNullSafe(other) & key.isNotNull()


def _condition(on: Sequence[str], equal: Equal) -> Column:
    return reduce(Column.__and__, [equal(named(k), named(f"__right_{k}")) for k in on])


def _plain(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, equal: Equal) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in on})
    joined = left.join(renamed, _condition(on, equal), JOIN_KINDS[how])
    sources = {
        "inner": lambda k: named(k),
        "left": lambda k: named(k),
        "right": lambda k: named(f"__right_{k}").alias(k),
        "outer": lambda k: F.coalesce(named(k), named(f"__right_{k}")).alias(k),
    }
    others = [c for c in left.columns if c not in on] + [c for c in right.columns if c not in on]
    return joined.select(*[sources[how](k) for k in on], *[named(c) for c in others])


def _split_outer(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, equal: Equal) -> DataFrame:
    """Outer join as an inner join plus unmatched rows: each part can split a hot key."""
    result = _plain(left, right, on, "inner", equal)
    if how in ("left", "outer"):
        unmatched = _matching(left, right, on, "left_anti", equal)
        result = result.unionByName(unmatched, allowMissingColumns=True)
    if how in ("right", "outer"):
        unmatched = _matching(right, left, on, "left_anti", equal)
        result = result.unionByName(unmatched, allowMissingColumns=True)
    return result
