"""Removal of long repeated byte strings, by radix passes over suffixes up to a limited depth.

Only strings of `width` bytes count, so suffixes are ordered no deeper than that. Instead of every
suffix of the corpus, those at anchors are taken: each window of `width` bytes names the least hash
of its GRAM-byte substrings, and equal windows name the same place in themselves. The passes are

1. the first GRAM bytes of the anchored suffixes (by their hash): groups of one are done;
2. what surrounds an anchor in the windows that named it: where that is equal, all of these windows
   are repeated, whatever the size of the group, so one of each kind is enough for the third pass;
3. kinds of one group are ordered byte by byte to both sides of the anchor. Windows that fall into
   one class are the repeated ones. Groups of more than MOST_KINDS kinds are instead dealt out by
   the whole windows, through an ordinary distributed aggregate.

Texts that stand in several rows are found first, by counted digests. Every window of theirs is
repeated, so these rows lose all bytes if they have a window at all, and only one row for each such
text takes part in the passes, as two, so that other texts with windows of it lose them. However
many copies there are, none of them lie in a shard. The other texts travel once, in shards of
bounded size; anchors are found again where they are needed.

Defined results: a null or empty text has no bytes and loses none; equal rows repeat each other, so
windows of theirs are removed from all of them; an empty table gives an empty table; `drop_repeats`
returns all columns, with the text cut, whatever their names. Characters that lose some of their
bytes are dropped there as a whole; null texts stay null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pipekit.llm.arrays import covered, extended, flat, sized_batches
from pipekit.operators import digests
from pipekit.session import saved

WIDTH, GRAM = 200, 100
NAMED = WIDTH - GRAM + 1  # substrings of a window
SHARD_BYTES = 4 * 1024 * 1024
BLOCK = 1 << 18  # window starts that are hashed at once, and about the bytes of a part of a shard
MOST_KINDS = 20_000

_PLACE = np.uint64(2 * BLOCK - 1)
_random = np.random.Generator(np.random.PCG64(7))
_VALUES = _random.integers(0, 2**64, (2, 256), np.uint64)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_CELLS = _random.integers(0, 2**64, (2, NAMED - 1 + WIDTH, 256), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of substrings from running sums."""

    def __init__(self, which: int):
        base, self.values = _BASES[which], _VALUES[which]
        n = BLOCK + 2 * WIDTH
        self.power = np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)
        inverse = pow(base, -1, 2**64)
        self.back = np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]).cumprod(dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.back[starts])


@dataclass
class Anchors:
    """Places of anchors in some bytes. The windows that name an anchor begin `least` to `most`
    bytes before it; `gram` and `kind` are hashes of the substring there and of all those windows."""

    at: np.ndarray
    least: np.ndarray
    most: np.ndarray
    gram: np.ndarray
    kind: np.ndarray


class Finder:
    def __init__(self):
        self.rolling = [Rolling(0), Rolling(1)]

    def anchors(self, data: np.ndarray, offsets: np.ndarray) -> Anchors:
        """Anchors of texts lying one after the other."""
        ends = np.repeat(offsets[1:], np.diff(offsets)) if len(data) else np.zeros(0, np.int64)
        parts, start, total = [], 0, len(data) - WIDTH + 1
        while start < total:
            found, last = self.block(data, ends, start)
            if last is not None and start + BLOCK < total:
                # The last anchor may name windows of the next block, which then begins with it.
                found = Anchors(*(getattr(found, f)[:-1] for f in Anchors.__dataclass_fields__))
                start = last
            else:
                start += BLOCK
            parts.append(found)
        parts.append(Anchors(*[np.zeros(0, np.int64)] * 5))
        return Anchors(*(np.concatenate([getattr(p, f) for p in parts]) for f in Anchors.__dataclass_fields__))

    def block(self, data: np.ndarray, ends: np.ndarray, start: int) -> tuple[Anchors, int | None]:
        """Anchors of the windows that begin in a block; if the last window is one, where the first
        one with the same anchor begins."""
        part = data[start : start + BLOCK + WIDTH - 1]
        n = len(part) - WIDTH + 1
        sums = self.rolling[0].sums(part)
        places = np.arange(len(part) - GRAM + 1)
        grams = mixed((sums[GRAM:] - sums[: len(places)]) * self.rolling[0].back[: len(places)])
        # Least gram of each window, the first one of equals, as its place.
        keys = (grams & ~_PLACE) | places.astype(np.uint64)
        rows = -(-len(keys) // NAMED) + 1
        keys = np.concatenate([keys, np.full(rows * NAMED - len(keys), 2**64 - 1, np.uint64)]).reshape(rows, NAMED)
        ahead = np.minimum.accumulate(keys, axis=1).ravel()
        back = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
        named = (np.minimum(back[:n], ahead[NAMED - 1 : n + NAMED - 1]) & _PLACE).astype(np.int64)
        begins = np.flatnonzero(np.arange(start + WIDTH, start + WIDTH + n) <= ends[start : start + n])
        named = named[begins]
        if not len(named):
            return Anchors(*[np.zeros(0, np.int64)] * 5), None
        new = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (begins[1:] != begins[:-1] + 1)]))
        at = named[new]
        most = at - begins[new]
        least = at - begins[np.concatenate([new[1:], [len(named)]]) - 1]
        kind = self.rolling[1].hashes(self.rolling[1].sums(part), at - most, at - least + WIDTH)
        kind = mixed(kind + (least * 256 + most).astype(np.uint64))
        found = Anchors(at + start, least, most, grams[at].view(np.int64), kind.view(np.int64))
        return found, start + int(begins[new[-1]]) if begins[-1] == n - 1 else None


def _spread(key: Column, text: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, text), F.lit(shards)).cast("int")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each kind of anchor of a shard, in the texts of a batch."""
    finder = Finder()
    for batch in sized_batches(batches, "text", 4 * BLOCK):
        data, offsets = flat(batch.column("text"))
        found = finder.anchors(data, offsets)
        row = np.searchsorted(offsets, found.at, side="right") - 1
        shard = np.asarray(batch.column("shard"))[row]
        order = np.lexsort((shard, found.kind, found.gram))
        gram, kind, shard = found.gram[order], found.kind[order], shard[order]
        rows = np.where(batch.column("copied").to_numpy(zero_copy_only=False)[row[order]], 2, 1)
        new = np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(kind) != 0) | (np.diff(shard) != 0)])[: len(gram)]
        first = np.flatnonzero(new)
        n = np.add.reduceat(rows, first) if len(first) else first
        yield pa.RecordBatch.from_pydict({"gram": gram[first], "kind": kind[first], "shard": shard[first], "n": n})


def _blocks(table: pa.Table, text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The rows of a shard in parts of bounded size, with their texts."""
    for batch in table.combine_chunks().to_batches():
        columns = [batch.column("row"), batch.column("row").field(text)]
        for part in sized_batches([pa.RecordBatch.from_arrays(columns, ["row", "text"])], "text", 4 * BLOCK):
            yield part, part.column("text")


def _matched(found: Anchors, gram: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor that a row has gram and kind of, and such a row."""
    if not len(gram) or not len(found.at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((kind, gram))
    gram, kind = gram[order], kind[order]
    # Rows of one gram are neighbours; joint ranks make one searchable number of both.
    grams, kinds = np.unique(gram), np.unique(kind)
    g, k = np.searchsorted(grams, found.gram), np.searchsorted(kinds, found.kind)
    known = (grams[np.minimum(g, len(grams) - 1)] == found.gram) & (kinds[np.minimum(k, len(kinds) - 1)] == found.kind)
    anchor = np.flatnonzero(known)
    rows = np.searchsorted(grams, gram) * len(kinds) + np.searchsorted(kinds, kind)
    joint = g[anchor] * len(kinds) + k[anchor]
    at = np.minimum(np.searchsorted(rows, joint), len(rows) - 1)
    same = rows[at] == joint
    return anchor[same], order[at[same]]


CONTEXT = "gram long, kind long, whole boolean, kinds long, least int, most int, context binary"


def _contexts(text: str):
    """What surrounds one anchor of each wanted kind, in a shard."""

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        finder, out = Finder(), []
        gram, kind = (wanted.column(c).to_numpy() for c in ("gram", "kind"))
        open_ = np.ones(len(gram), bool)
        for _, texts in _blocks(rows, text) if len(gram) else ():
            data, offsets = flat(texts)
            found = finder.anchors(data, offsets)
            anchor, row = _matched(found, gram, kind)
            row, first = np.unique(row, return_index=True)
            anchor, row = anchor[first][open_[row]], row[open_[row]]
            open_[row] = False
            at, least, most = found.at[anchor], found.least[anchor], found.most[anchor]
            parts = [data[a:b].tobytes() for a, b in zip(at - most, at - least + WIDTH)]
            taken = wanted.take(pa.array(row))
            out.append(
                pa.table(
                    {
                        "gram": taken.column("gram"),
                        "kind": taken.column("kind"),
                        "whole": taken.column("whole"),
                        "kinds": taken.column("kinds"),
                        "least": pa.array(least.astype(np.int32)),
                        "most": pa.array(most.astype(np.int32)),
                        "context": pa.array(parts, pa.binary()),
                    }
                )
            )
        if out:
            return pa.concat_tables(out)
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["gram", "kind", "whole", "kinds", "least", "most", "context"]
        return pa.table([pa.array([], t) for t in types], names)

    return run


def _aligned(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as rows of bytes with the anchors in column NAMED - 1; their least and most."""
    data, offsets = flat(batch.column("context"))
    least, most = np.asarray(batch.column("least")), np.asarray(batch.column("most"))
    out = np.zeros((len(least), NAMED - 1 + WIDTH), np.uint8)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(least)), sizes)
    out[row, np.arange(len(data)) - np.repeat(offsets[:-1], sizes) + np.repeat(NAMED - 1 - most, sizes)] = data
    return out, least, most


class Classes:
    """Rows in classes of equal prefixes; a pass adds a byte and splits the classes that differ."""

    def __init__(self, group: np.ndarray):
        _, self.first, of = np.unique(group, return_index=True, return_inverse=True)
        self.of = of.astype(np.int64)

    def add(self, byte: np.ndarray) -> None:
        differ = byte != byte[self.first[self.of]]
        if not differ.any():
            return
        split = np.zeros(len(self.first), bool)
        split[self.of[differ]] = True
        rows = np.flatnonzero(split[self.of])
        _, first, which = np.unique(self.of[rows] * 256 + byte[rows], return_index=True, return_inverse=True)
        self.of[rows] = len(self.first) + which
        self.first = np.concatenate([self.first, rows[first]])


def repeated_windows(group: np.ndarray, context: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each row and number of bytes before the anchor, whether another row of its group has
    the same window there."""
    n, middle = len(group), NAMED - 1
    out = np.zeros((n, NAMED), bool)
    right = Classes(group)
    for i in range(GRAM):
        right.add(context[:, middle + i])
    ahead = np.zeros((NAMED, n), np.int64)
    ahead[0] = right.of
    for i in range(NAMED - 1):
        right.add(context[:, middle + GRAM + i])
        ahead[i + 1] = right.of
    left = Classes(group)
    for before in range(NAMED):
        if before:
            left.add(context[:, middle - before])
        rows = np.flatnonzero((least <= before) & (before <= most))
        joint = left.of[rows] * len(right.first) + ahead[WIDTH - before - GRAM][rows]
        _, which, count = np.unique(joint, return_inverse=True, return_counts=True)
        out[rows, before] = count[which] > 1
    return out


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated windows of contexts that come sorted by gram."""

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(parts)
        context, least, most = _aligned(batch)
        found = repeated_windows(np.asarray(batch.column("gram")), context, least, most)
        found[np.asarray(batch.column("whole"))] = False  # all of theirs are known to be repeated
        rows = np.flatnonzero(found.any(axis=1))
        before = [np.flatnonzero(found[i]).astype(np.int32) for i in rows]
        taken = batch.take(pa.array(rows))
        columns = [taken.column("gram"), taken.column("kind"), pa.array(before, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["gram", "kind", "before"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= MOST_KINDS:
            joined = pa.concat_batches(held)
            gram = np.asarray(joined.column("gram"))
            last = int(np.searchsorted(gram, gram[-1]))  # this group may go on
            if last:
                yield done([joined.slice(0, last)])
            held = [joined.slice(last)]
    if held:
        yield done(held)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each context as a row with two hashes."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            context, least, most = _aligned(batch)
            sums = []
            for table in _CELLS:
                values = table[np.arange(context.shape[1]), context]
                sums.append(np.concatenate([np.zeros((len(least), 1), np.uint64), values.cumsum(axis=1)], axis=1))
            row, before = np.nonzero((least[:, None] <= np.arange(NAMED)) & (np.arange(NAMED) <= most[:, None]))
            begin = NAMED - 1 - before
            hashes = [mixed(s[row, begin + WIDTH] - s[row, begin]).view(np.int64) for s in sums]
            gram, kind, full = (np.asarray(batch.column(c))[row] for c in ("gram", "kind", "whole"))
            names = ["gram", "kind", "whole", "before", "one", "two"]
            columns = [gram, kind, full, before.astype(np.int32), *hashes]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _cut(text: str, characters: bool):
    """The removed spans and the remaining bytes of a shard's texts."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        finder, out = Finder(), []
        rows = rows.filter(pc.invert(rows.column("copied")))
        told = told.combine_chunks()
        gram, kind = (told.column(c).to_numpy() for c in ("gram", "kind"))
        listed = told.column("before")
        listed = listed.chunk(0) if listed.num_chunks else pa.array([], pa.list_(pa.int32()))
        sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        before = listed.flatten().to_numpy(zero_copy_only=False)
        first = np.cumsum(sizes) - sizes
        every = listed.is_null().to_numpy(zero_copy_only=False)
        for part, texts in _blocks(rows, text):
            data, offsets = flat(texts)
            spans: list[list[dict]] = [[] for _ in range(len(texts))]
            gone = np.zeros(len(data), bool)
            if len(gram):
                found = finder.anchors(data, offsets)
                anchor, row = _matched(found, gram, kind)
                all_, some = every[row], ~every[row]
                at = found.at[anchor[all_]]
                starts = at - found.most[anchor[all_]]
                ends = at - found.least[anchor[all_]] + WIDTH
                n = sizes[row[some]]
                which = np.repeat(first[row[some]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                begin = np.repeat(found.at[anchor[some]], n) - before[which]
                gone = covered(np.concatenate([starts, begin]), np.concatenate([ends, begin + WIDTH]), len(data))
            # Runs end with their text.
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets[:-1]] = True
            begins = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
            stops = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
            of = np.searchsorted(offsets, begins, side="right") - 1
            for i, a, b in zip(of.tolist(), (begins - offsets[of]).tolist(), (stops - offsets[of]).tolist()):
                spans[i].append({"start": a, "end": b})
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:])]
            if characters:
                kept = [k.decode(errors="ignore").encode() for k in kept]
            out.append(
                pa.table(
                    {
                        "row": part.column("row"),
                        "n_bytes": pa.array(np.diff(offsets)),
                        "spans": pa.array(spans, SPANS),
                        "kept": pa.array(kept, pa.binary()),
                    }
                )
            )
        if out:
            return pa.concat_tables(out)
        empty = pa.table({"row": rows.column("row").slice(0, 0)})
        for name, kind_ in (("n_bytes", pa.int64()), ("spans", SPANS), ("kept", pa.binary())):
            empty = empty.append_column(name, pa.array([], kind_))
        return empty

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", characters: bool = False) -> DataFrame:
    """`row` (all columns), `n_bytes`, `spans` (removed, in bytes) and `kept` (bytes) of each row.

    `key` only spreads the rows. With `characters`, bytes of `kept` that are no UTF-8 are left out.
    """
    inner = F.col("row")
    packed = df.select(F.struct("*").alias("row")).withColumn("text", inner.getField(text))
    size = packed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = math.ceil(size / SHARD_BYTES) or 1
    found = digests.repeats(packed, ["text"])
    single = found.single if found.repeated <= digests.MOST_BROADCAST else saved(found.single, "single")
    has_window = F.octet_length("text") >= WIDTH
    copied = saved(found.candidates.where(has_window).select("text").distinct(), "copied")

    rows = single.select("row", F.lit(False).alias("copied"))
    alone = [(F.col("text") if f.name == text else F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema]
    rows = rows.union(copied.select(F.struct(*alone).alias("row"), F.lit(True).alias("copied")))
    rows = rows.withColumn("shard", _spread(inner.getField(key), inner.getField(text), shards))
    placed = rows.select(inner.getField(text).alias("text"), "shard", "copied")
    anchors = placed.mapInArrow(_find, "gram long, kind long, shard int, n long")
    again = anchors.groupBy("gram").agg(F.sum("n").alias("total")).where("total > 1").select("gram")
    anchors = saved(anchors.join(again, "gram"), "anchors")
    kinds = anchors.groupBy("gram", "kind").agg(F.sum("n").alias("n"), F.min("shard").alias("shard"))
    kinds = saved(kinds.select("gram", "kind", (F.col("n") > 1).alias("whole"), "shard"), "kinds")
    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    most = several.agg(F.max("kinds")).first()[0] or 0

    by_shard = rows.groupBy("shard")
    wanted = kinds.join(several, "gram")
    contexts = by_shard.cogroup(wanted.groupBy("shard")).applyInArrow(_contexts(text), CONTEXT)
    near = contexts.where(F.col("kinds") <= MOST_KINDS).repartition("gram").sortWithinPartitions("gram")
    windows = near.mapInArrow(_order, "gram long, kind long, before array<int>")
    if most > MOST_KINDS:
        cells = contexts.where(F.col("kinds") > MOST_KINDS)
        cells = cells.mapInArrow(_cells, "gram long, kind long, whole boolean, before int, one long, two long")
        same = ["gram", "before", "one", "two"]
        double = cells.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*same)
        marked = cells.where(~F.col("whole")).join(double, same)
        windows = windows.union(marked.groupBy("gram", "kind").agg(F.collect_set("before").alias("before")))
    verdict = kinds.select("gram", "kind", "whole").join(windows, ["gram", "kind"], "left")
    verdict = verdict.where(F.col("whole") | F.col("before").isNotNull())
    verdict = verdict.select("gram", "kind", F.when(~F.col("whole"), F.col("before")).alias("before"))
    told = anchors.select("shard", "gram", "kind").join(verdict, ["gram", "kind"])
    schema = extended(rows, ["row"], "n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    cut = by_shard.cogroup(told.groupBy("shard")).applyInArrow(_cut(text, characters), schema)
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
    gone = found.candidates.select(
        "row",
        n.alias("n_bytes"),
        F.when(has_window, whole).otherwise(F.array().cast("array<struct<start: long, end: long>>")).alias("spans"),
        F.when(has_window, F.lit("")).otherwise(F.coalesce("text", F.lit(""))).cast("binary").alias("kept"),
    )
    return cut.union(gone)


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """All rows and columns, with the repeated strings cut out of `text`.

    `length` names a column that holds the number of characters and follows the text.
    """
    kept = F.col("kept").cast("string")
    columns = []
    for field in df.schema:
        old = F.col("row").getField(field.name)
        new = kept if field.name == text else F.length(kept).cast(field.dataType)
        present = F.col("row").getField(text).isNotNull() & old.isNotNull()
        columns.append((F.when(present, new).otherwise(old) if field.name in (text, length) else old).alias(field.name))
    return repeats(df, key, text, characters=True).select(*columns)


__all__ = ["Finder", "drop_repeats", "repeated_windows", "repeats"]
