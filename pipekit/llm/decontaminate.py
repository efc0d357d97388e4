"""Benchmark decontamination with suffix arrays of the training texts.

Words are runs of digits, letters and bytes above 0x7F, with A-Z in lower case. Each batch of
documents is a shard with a suffix array over its words; every suffix of a test item is looked up
in it by binary search, first by its leading words, then, in the part of the order that is left, by
the next ones. The array is sorted no deeper than the searches go. A test item's windows are its
strings of `window` words, or the whole item if it has fewer; each occurrence of a window marks the
document's words. Marked runs (`spans`) are unions of windows, which may be of several items;
`matches` keeps item and offset with each place, and joins the places that follow each other in both
to the longest verbatim matches.

Each test item is taken once, in blocks of a bounded number of bytes, which are counted before a
block is collected; a single larger item is a block of its own. With more than one block, the marks
found so far travel with the rows and are written between the blocks.

Defined results: null and empty texts have no words, and neither match nor are matched; a null item
id is the empty string; equal rows are judged alike and all returned; without test items nothing is
contaminated; an empty table gives an empty table; other columns are ignored by `contamination` and
`matches`, and passed through by `decontaminate`, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pipekit.llm.arrays import chosen, covered, extended, flat, per_text, sized_batches
from pipekit.operators.keys import named
from pipekit.session import saved

WINDOW = 10
BLOCK_BYTES = 8 * 1024 * 1024

WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
PACKED, BITS = 3, 21  # words in one digit of a key, bits for each
MOST_WORDS = (1 << BITS) - 2


def split_words(column: pa.Array) -> list[list[bytes]]:
    data, offsets = flat(column)
    whole, cuts = data.tobytes().translate(WORD_BYTES), offsets.tolist()
    return [whole[a:b].split() for a, b in zip(cuts, cuts[1:])]


class Tests:
    """The distinct windows of a block of test items, and which items have them; `located`, also where."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, located: bool = False):
        self.window = window
        words = split_words(pa.array([text for _, text in items], pa.string()))
        self.number: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        place = {item: i for i, item in enumerate(self.items)}
        owners: dict[tuple, set[int]] = defaultdict(set)
        for (item, _), of in zip(items, words):
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in of]
            for start in range(max(1, len(numbers) - window + 1) if numbers else 0):
                owners[tuple(numbers[start : start + window])].add(place[item])
        if located:
            self.names = [item for item, _ in items]
            self.spots, self.n_spots = self._spots([[self.number[w] for w in of] for of in words], {w: i for i, w in enumerate(owners)})
            self.first_spot = np.cumsum(self.n_spots) - self.n_spots
        if len(self.number) > MOST_WORDS:
            raise ValueError(f"a block has more than {MOST_WORDS} distinct words")
        self.length = np.array([len(w) for w in owners], np.int64)
        self.n_owners = np.array([len(o) for o in owners.values()], np.int64)
        self.owners = np.array([i for o in owners.values() for i in sorted(o)], np.int64)
        self.first_owner = np.cumsum(self.n_owners) - self.n_owners
        digits = math.ceil(window / PACKED)
        padded = np.zeros((len(owners), digits * PACKED), np.int64)
        open_ = np.full_like(padded, (1 << BITS) - 1)
        for i, w in enumerate(owners):
            padded[i, : len(w)] = open_[i, : len(w)] = w
        # The least and greatest key that begins with the window, digit by digit.
        self.low, self.high = self._digits(padded), self._digits(open_)

    def _spots(self, words: list[list[int]], number: dict[tuple, int]) -> tuple[np.ndarray, np.ndarray]:
        """The (row, offset) of all windows, dealt by window, and how many each has."""
        found: list[tuple[int, int, int]] = []
        for row, of in enumerate(words):
            for start in range(max(1, len(of) - self.window + 1) if of else 0):
                found.append((number[tuple(of[start : start + self.window])], row, start))
        spots = np.array(found, np.int64).reshape(-1, 3)
        sizes = np.bincount(spots[:, 0], minlength=len(number))
        return spots[np.argsort(spots[:, 0], kind="stable"), 1:], sizes

    @staticmethod
    def _digits(words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), words.shape[1] // PACKED), np.int64)
        for i in range(words.shape[1]):
            out[:, i // PACKED] = (out[:, i // PACKED] << BITS) | words[:, i]
        return out


class Shard:
    """A suffix array over the words of some documents, sorted as deep as searches need."""

    def __init__(self, numbers: np.ndarray, ends: np.ndarray):
        # Words that no item has are 0; so is what lies behind the end of a document.
        self.numbers, self.ends = numbers, ends
        self.order = np.flatnonzero(numbers)
        key = self.digit(self.order, 0)
        by = np.argsort(key, kind="stable")
        self.order, self.key = self.order[by], key[by]

    def digit(self, at: np.ndarray, digit: int) -> np.ndarray:
        """The words digit * PACKED and following of the suffixes at `at`, as one number."""
        out = np.zeros(len(at), np.int64)
        last = len(self.numbers) - 1
        for i in range(digit * PACKED, (digit + 1) * PACKED):
            word = np.where(at + i < self.ends[at], self.numbers[np.minimum(at + i, last)], 0)
            out = (out << BITS) | word
        return out

    def search(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, place) such that the suffix at the place lies between the query's keys.

        Keys agree in their leading digits; from the digit in which they differ on, all fits.
        """
        query = np.arange(len(low))
        if not len(self.order) or not len(query):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order, first, last = self.order, None, None
        first = np.searchsorted(self.key, low[:, 0], "left")
        last = np.searchsorted(self.key, high[:, 0], "right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for digit in range(low.shape[1]):
            met = first < last
            query, first, last = query[met], first[met], last[met]
            whole = low[query, digit] != high[query, digit]
            if digit == low.shape[1] - 1:
                whole[:] = True
            found.append(_places(query[whole], order, first[whole], last[whole]))
            query, first, last = query[~whole], first[~whole], last[~whole]
            if not len(query):
                break
            # Sort each part of the order that is still searched by the next digit.
            part, own = np.unique(first, return_index=True)
            of, at = _places(np.arange(len(part)), order, first[own], last[own])
            key = self.digit(at, digit + 1)
            by = np.lexsort((key, of))
            order, of, key = at[by], of[by], key[by]
            in_part = np.searchsorted(part, first)
            steps = np.unique(np.concatenate([key, low[query, digit + 1], high[query, digit + 1]]))
            joint = of * len(steps) + np.searchsorted(steps, key)
            first = np.searchsorted(joint, in_part * len(steps) + np.searchsorted(steps, low[query, digit + 1]), "left")
            last = np.searchsorted(joint, in_part * len(steps) + np.searchsorted(steps, high[query, digit + 1]), "right")
        return tuple(np.concatenate(x) for x in zip(*found))


def _places(names: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each name with the members order[first:last] of its range."""
    sizes = last - first
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
    return np.repeat(names, sizes), order[at]


def _runs(hit: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
    """The marked runs of each document, from its first word on."""
    steps = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    for start, end in zip(starts.tolist(), ends.tolist()):
        while start < end:  # runs that touch the next document belong to both
            doc = int(np.searchsorted(bounds, start, side="right")) - 1
            stop = min(end, int(bounds[doc + 1]))
            out[doc].append({"start": start - int(bounds[doc]), "end": stop - int(bounds[doc])})
            start = stop
    return out


def locate(column: pa.Array, tests: Tests) -> dict[str, np.ndarray]:
    """Longest matches: the `text`, the `item` (a row of the block), where both begin, and the words."""
    words = split_words(column)
    counts = np.array([len(w) for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    numbers = np.fromiter((tests.number.get(w, 0) for of in words for w in of), np.int64, int(bounds[-1]))
    query, place = Shard(numbers, np.repeat(bounds[1:], counts)).search(tests.low, tests.high)
    n = tests.n_spots[query]
    at = np.repeat(tests.first_spot[query] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    item, offset, place, length = *tests.spots[at].T, np.repeat(place, n), np.repeat(tests.length[query], n)
    text = np.searchsorted(bounds, place, side="right") - 1
    by = np.lexsort((place, place - offset, item, text))
    item, offset, place, length, text = (x[by] for x in (item, offset, place, length, text))
    same = (np.diff(text) == 0) & (np.diff(item) == 0) & (np.diff(place) == 1) & (np.diff(offset) == 1)
    first = np.flatnonzero(np.concatenate([[True], ~same])[: len(by)])
    last = np.concatenate([first[1:], [len(by)]])[: len(first)] - 1
    size = place[last] + length[last] - place[first]
    return {"text": text[first], "item": item[first], "start": place[first] - bounds[text[first]], "item_start": offset[first], "words": size}


def examine(column: pa.Array, tests: Tests, spans: list[list[dict]] | None = None) -> dict[str, list]:
    """`n_words`, the marked `spans` (with those already known) and the `items` of each text."""
    words = split_words(column)
    known = tests.number
    counts = np.array([len(w) for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(bounds[-1])
    numbers = np.fromiter((known.get(w, 0) for of in words for w in of), np.int64, total)
    query, place = Shard(numbers, np.repeat(bounds[1:], counts)).search(tests.low, tests.high)
    starts, ends = place, place + tests.length[query] if len(place) else place
    if spans:
        more = [(bounds[i] + s["start"], bounds[i] + s["end"]) for i, of in enumerate(spans) for s in of]
        starts = np.concatenate([starts, np.array([a for a, _ in more], np.int64)])
        ends = np.concatenate([ends, np.array([b for _, b in more], np.int64)])
    hit = covered(starts, ends, total)
    doc = np.searchsorted(bounds, place, side="right") - 1
    pairs = np.unique(doc * max(1, len(tests.length)) + query)
    doc, query = np.divmod(pairs, max(1, len(tests.length)))
    n = tests.n_owners[query]
    owner = np.repeat(tests.first_owner[query] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    items: list[set[int]] = [set() for _ in words]
    for d, i in zip(np.repeat(doc, n).tolist(), tests.owners[owner].tolist()):
        items[d].add(i)
    return {
        "n_words": counts,
        "n_hit": per_text(hit, bounds),
        "spans": _runs(hit, bounds),
        "items": [[tests.items[i] for i in sorted(of)] for of in items],
    }


def _blocks(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, list[int]]:
    """The distinct test items with a block number, and the numbers there are.

    No block has more than BLOCK_BYTES of ids and text, unless it is a single item.
    """
    rows = chosen(benchmark, item=item, text=text)
    rows = rows.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text").distinct()
    rows = saved(rows.withColumn("block", F.lit(0).cast("long")), "items")
    bytes_ = F.sum(F.octet_length("item") + F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")
    last = level = 0
    while True:
        sizes = rows.groupBy("block").agg(bytes_, F.count(F.lit(1)).alias("n")).collect()
        large = [row for row in sizes if row.bytes > BLOCK_BYTES and row.n > 1]
        if not large:
            return rows, sorted(row.block for row in sizes) or [0]
        level, block = level + 1, F.col("block")
        for row in large:
            parts = max(2, math.ceil(2 * row.bytes / BLOCK_BYTES))
            part = last + 1 + F.pmod(F.xxhash64("item", "text", F.lit(level)), F.lit(parts))
            block, last = F.when(F.col("block") == row.block, part).otherwise(block), last + parts
        rows = saved(rows.withColumn("block", block), "items")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>"


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """`key`, `n_words`, `n_hit`, `spans` (runs of hit words) and `items` of each row."""
    found = _contamination(chosen(df, key=key, text=text), benchmark, item, item_text, window)
    return found.select(F.col("key").alias(key), "n_words", "n_hit", "spans", "items")


def matches(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The longest verbatim matches: `key`, `start` in the row's words, `item`, `item_start`, and `words`, how many."""
    rows = chosen(df, key=key, text=text)
    blocks, numbers = _blocks(benchmark, item, item_text)
    found = None
    for block in numbers:
        own = blocks.where(F.col("block") == block).select("item", "text").toArrow().to_pydict()
        tests = Tests(list(zip(own["item"], own["text"])), window, located=True)

        def run(batches: Iterator[pa.RecordBatch], tests: Tests = tests) -> Iterator[pa.RecordBatch]:
            for batch in sized_batches(batches, "text"):
                at = locate(batch.column("text"), tests)
                items = pa.array([tests.names[i] for i in at["item"].tolist()], pa.string())
                columns = [batch.column("key").take(pa.array(at["text"])), pa.array(at["start"]), items]
                columns += [pa.array(at["item_start"]), pa.array(at["words"])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "item", "item_start", "words"])

        part = rows.mapInArrow(run, extended(rows, ["key"], "start long, item string, item_start long, words long"))
        found = part if found is None else found.union(part)
    return found.withColumnRenamed("key", key)


def _contamination(rows: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int) -> DataFrame:
    schema = extended(rows, ["key"], f"text string, {FOUND}")
    blocks, numbers = _blocks(benchmark, item, item_text)
    for i, block in enumerate(numbers):
        own = blocks.where(F.col("block") == block).select("item", "text").toArrow().to_pydict()
        tests = Tests(list(zip(own["item"], own["text"])), window)

        def run(batches: Iterator[pa.RecordBatch], tests: Tests = tests, more: bool = i > 0) -> Iterator[pa.RecordBatch]:
            for batch in sized_batches(batches, "text"):
                spans = batch.column("spans").to_pylist() if more else None
                found = examine(batch.column("text"), tests, spans)
                if more:
                    before = batch.column("items").to_pylist()
                    found["items"] = [sorted({*a, *b}) for a, b in zip(before, found["items"])]
                columns = [batch.column("key"), batch.column("text"), pa.array(found["n_words"]), pa.array(found["n_hit"])]
                columns += [pa.array(found["spans"], SPANS), pa.array(found["items"], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "text", "n_words", "n_hit", "spans", "items"])

        rows = rows.mapInArrow(run, schema)
        if i < len(numbers) - 1:
            rows = saved(rows, "marked")
    return rows


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The rows none of whose words lies in a test item's window, with all their columns."""
    rows = df.select(F.struct("*").alias("key"), named(text).alias("text"))
    return _contamination(rows, benchmark, item, item_text, window).where("n_hit = 0").select("key.*")


__all__ = ["Shard", "Tests", "contamination", "decontaminate", "examine", "locate", "matches"]
