"""SimHash near-duplicates through an index of fingerprint bytes by position.

Two 64-bit fingerprints that differ in at most 2 bits share at least 6 of their 8 bytes in place.
The index therefore holds every distinct fingerprint under each choice of 6 positions: fingerprints
meet in a list only where their tally of shared bytes reaches that minimum. A list holds the values
of the 2 bytes left out, 65,536 fingerprints at most whatever the table's size; long lists are
searched by flipping bits instead of comparing pairs. Pairs that pass are edges between distinct
fingerprints, and components are found by alternating large and small stars.

`keep_one` leaves one row of each component.

Defined results: null and empty texts have no words and fingerprint zero, and are linked like any
other; a null key is never the smallest of a component unless all its keys are null; an empty table
gives an empty table. `near_duplicates` returns equal rows, all of them, and ignores other columns.
`keep_one` passes them through; of rows with the least key of a component it keeps the one whose text
has the least hash, and of rows alike in key and text the first by its other columns, in their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pipekit.llm.arrays import chosen, extended, sized_batches, texts
from pipekit.operators.keys import hashable
from pipekit.session import saved

SHINGLE, SEED, BITS = 3, 42, 2
LONG = 4 * 1024 * 1024  # bytes of a text whose words are held at once
SPACE = re.compile(rb"[\x20\x09-\x0D]")
LEFT_OUT = list(combinations(range(8), 2))  # byte positions, 0 the lowest
COMPARED = 128  # longer lists are searched by flips
POSTINGS = 1_000_000  # of a task that lists fingerprints
FLIPS = np.array([(1 << i) ^ (1 << j) if i != j else 1 << i for i in range(16) for j in range(i, 16)], np.int64)
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, about LONG bytes of it at a time."""
    size = SHINGLE
    held: list[bytes] = []  # the last words, which begin shingles that go on
    start = seen = 0
    while start < len(text):
        found = SPACE.search(text, start + LONG) if len(text) - start > LONG else None
        stop = found.start() if found else len(text)
        words = held + text[start:stop].split()
        start, joined = stop, b" ".join(words)
        last, n = start == len(text), len(words)
        if n >= size:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            spans = zip(np.concatenate([[0], ends[:-1]]).tolist(), (ends[size - 1 :] - 1).tolist())
            yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
            seen, held = 1, words[n - size + 1 :]
        else:
            held = words
        if last and n and not seen:
            yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit numbers."""
    parts = [list(_shingle_hashes(text.lower())) for text in texts(column)]
    n, counts = len(parts), np.array([sum(map(len, own)) for own in parts], np.int64)
    rows = np.repeat(np.arange(n) * 256, counts)
    values = np.concatenate([np.zeros(0, ">u8"), *[p for own in parts for p in own]]).astype(">u8")
    values = values.view(np.uint8).reshape(-1, 8)
    bits = np.zeros((n, 64), bool)
    for byte in range(8):
        tally = np.bincount(rows + values[:, byte], minlength=n * 256).reshape(n, 256)
        bits[:, 8 * byte : 8 * byte + 8] = 2 * (tally @ BYTE_BITS) > counts[:, None]
    return np.packbits(bits, axis=1).view(">u8").astype("u8").view(np.int64).reshape(n)


def fingerprinted(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `content` (a hash of the text) and `print`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            columns = [batch.column("key"), batch.column("content"), pa.array(fingerprints(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "content", "print"])

    rows = chosen(df, key=key, text=text).withColumn("content", F.xxhash64("text"))
    return rows.mapInArrow(run, extended(rows, ["key", "content"], "print long"))


def _without(slot: int) -> int:
    p, q = LEFT_OUT[slot]
    return np.int64(np.uint64(~((0xFF << 8 * p) | (0xFF << 8 * q)) & (2**64 - 1))).item()


def _links(slots: np.ndarray, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each list that differ in at most BITS bits, each pair in one of its lists only."""
    heads = np.cumsum(sizes) - sizes
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    small = sizes <= COMPARED
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.flatnonzero(small[of])
    left = heads[of] + sizes[of] - 1  # last place of the list
    for distance in range(1, int(sizes[small].max(initial=1))):
        place = place[place + distance <= left[place]]
        pairs.append((place, place + distance))
    for k in np.flatnonzero(~small):
        members = prints[heads[k] : heads[k] + sizes[k]]
        p, q = LEFT_OUT[slots[k]]
        rest = ((members >> 8 * p) & 0xFF) | (((members >> 8 * q) & 0xFF) << 8)
        where = np.full(65536, -1)
        where[rest] = np.arange(len(rest))
        for flip in FLIPS:
            other = where[rest ^ flip]
            at = np.flatnonzero(other > np.arange(len(rest)))
            pairs.append((heads[k] + at, heads[k] + other[at]))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*pairs))
    differ = prints[a] ^ prints[b]
    close = np.bitwise_count(differ.view(np.uint64)) <= BITS
    a, b, differ = a[close], b[close], differ[close]
    unlike = differ.view(np.uint8).reshape(-1, 8) != 0
    tally = 8 - unlike.sum(axis=1)
    # A pair with 7 shared bytes meets in 7 lists; the first of them reports it.
    only = unlike.argmax(axis=1)
    first = np.where(only == 0, 0, only - 1)
    told = (tally == 6) | (slots[of[a]] == first)
    return prints[a[told]], prints[b[told]]


def links(prints: DataFrame) -> DataFrame:
    """Pairs (`a`, `b`) of the distinct `print` values that differ in at most 2 bits."""
    masks = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(_without(i)).alias("mask")) for i in range(len(LEFT_OUT))])
    postings = prints.select("print", F.explode(masks).alias("m")).select(
        F.col("m.slot").alias("slot"), F.col("print").bitwiseAND(F.col("m.mask")).alias("bytes"), "print"
    )
    lists = postings.groupBy("slot", "bytes").agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # 256 lists of 65,536 at most
                part = batch.slice(start, 256)
                column = part.column("prints")
                sizes = np.asarray(column.value_lengths()).astype(np.int64)
                a, b = _links(np.asarray(part.column("slot")), np.asarray(column.flatten()), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return lists.select("slot", "prints").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node of its component, for all nodes of the edges (`a`, `b`)."""

    def mark(stars: DataFrame) -> tuple:
        return stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, mark(edges)
    while before != now:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct(), "stars")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = least(down)
        moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = saved(moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "stars")
        before, now = now, mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _grouped(rows: DataFrame, smallest: Column) -> DataFrame:
    """`print` and the least `smallest` of its component."""
    prints = rows.select("print").distinct()
    # A print is listed 28 times: as many tasks as these postings need, not as the prints do.
    tasks = max(1, rows.count() * len(LEFT_OUT) // POSTINGS)
    rooted = components(links(prints.repartition(tasks, "print")))
    own = rows.groupBy("print").agg(smallest.alias("own"))
    named = own.join(rooted.withColumnRenamed("node", "print"), "print", "left")
    named = named.withColumn("root", F.coalesce("root", "print"))
    first = named.groupBy("root").agg(F.min("own").alias("first"))
    return named.join(first, "root").select("print", "first")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `fingerprint` (16 hex digits) and `component_id`, the smallest key of the component."""
    rows = saved(fingerprinted(df, key, text), "prints")
    found = rows.join(_grouped(rows, F.min("key")), "print")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select(F.col("key").alias(key), digits.alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that with the smallest key (null keys last), with all its columns."""
    rows = saved(fingerprinted(df, key, text), "prints")
    own = F.struct(F.col("key").isNull().alias("absent"), "key", "content")
    kept = saved(_grouped(rows, F.min(own)).select("first.key", "first.content").distinct(), "kept")
    whole = df.select(F.struct("*").alias("row"))
    whole = whole.withColumn("id", F.col("row").getField(key)).withColumn("hash", F.xxhash64(F.col("row").getField(text)))
    stays = whole.join(kept, F.col("id").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("content")), "left_semi")
    others = [F.col("row").getField(f.name) for f in df.schema if f.name not in (key, text) and hashable(f.dataType)]
    first = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.col("row").getField(text), *others))
    return stays.withColumn("n", first).where("n = 1").select("row.*")


__all__ = ["components", "fingerprints", "keep_one", "links", "near_duplicates"]
