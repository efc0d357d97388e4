"""Quality rules on words, and repetition found with a suffix array of each text.

Words are runs of bytes other than space and 0x09-0x0D. The suffixes of all texts of a batch are
sorted by prefix doubling; longest common prefixes of neighbours give, for each place, the longest
string that starts there and again elsewhere in the same text. The union of those of at least
`min_repeat` words is the covered part; a text fails if that part or the longest repeat is too large.

Defined results: a null or empty text has no words and fails the base rule; equal rows are judged
alike and all returned; an empty table gives an empty table; columns not asked for are ignored, in
`keep_quality` they pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pipekit.llm.arrays import chosen, covered, extended, flat, per_text, sized_batches

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
CODE_POINT = (np.arange(256) & 0xC0) != 0x80

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.3, 60

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
RESULT = ", ".join(f"{name} long" for name in COUNTS) + ", base_failed boolean, kept boolean"


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place of each text, the words of the longest string that starts there and at
    another place of the same text.

    `words` holds word numbers of all texts in a row, `ends` for each place the end of its text.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n == 0:
        return best
    place = np.arange(n)
    size = int(words.max()) + 1
    # Level 0: equal first words of one text. A text is named by its end.
    first = ends * size + words
    order = np.argsort(first, kind="stable")
    head = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        # Slots of the order that share their rank with a neighbour are sorted by what follows.
        alone = head & np.concatenate([head[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        after = at + step
        inside = after < ends[at]
        key = rank[at] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        step *= 2
        levels.append(rank.astype(np.int32))
    # Longest common prefixes of neighbours in the order, from the longest step down.
    left, right = order[:-1], order[1:]
    same = levels[0][left] == levels[0][right]
    left, right = left[same], right[same]
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < ends[left]) & (b < ends[right])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        common += np.where(inside & (levels[level][a] == levels[level][b]), 1 << level, 0)
    np.maximum.at(best, left, common)
    np.maximum.at(best, right, common)
    return best


def measure(column: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each text of a column."""
    data, offsets = flat(column)
    space = SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[inner] = ~space[inner]
    n_words = per_text(starts, offsets)
    whole, cuts = data.tobytes(), offsets.tolist()
    number: dict[bytes, int] = defaultdict(count().__next__)
    words, dup_lines = [], np.zeros(len(column), np.int64)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        text = whole[a:b]
        words.append(np.fromiter(map(number.__getitem__, text.split()), np.int64))
        lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        dup_lines[i] = len(lines) - len(set(lines))
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    place_end = np.repeat(bounds[1:], n_words)
    best = longest_repeats(np.concatenate(words) if words else np.zeros(0, np.int64), place_end)
    total = int(bounds[-1])

    def words_in(length: int, spans: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(best >= length)
        return per_text(covered(at, at + spans[at], total), bounds)

    longest = np.zeros(len(column), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(column)), n_words), best)
    return {
        "n_words": n_words,
        "word_chars": per_text(CODE_POINT[data] & ~space, offsets),
        "n_symbols": per_text(SYMBOL[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": words_in(3, np.full(total, 3)),
        "covered_words": words_in(min_repeat, best),
        "longest_repeat": longest,
    }


def judged(found: dict[str, np.ndarray], max_covered: float, max_longest: int) -> dict[str, np.ndarray]:
    n = found["n_words"]
    failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    repeats = (found["covered_words"] > max_covered * n) & (found["longest_repeat"] > 0)
    return {"base_failed": failed, "kept": ~(failed | repeats | (found["longest_repeat"] > max_longest))}


def quality_rules(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """`key` with the counts and the verdict of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            found = measure(batch.column("text"), min_repeat)
            found |= judged(found, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, found.values())], ["key", *found])

    rows = chosen(df, key=key, text=text)
    done = rows.mapInArrow(run, extended(rows, ["key"], RESULT))
    return done.withColumnRenamed("key", key)


def keep_quality(
    df: DataFrame,
    text: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """The rows whose text passes all rules, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, text):
            found = measure(batch.column(text), min_repeat)
            yield batch.filter(pa.array(judged(found, max_covered, max_longest)["kept"]))

    return df.mapInArrow(run, df.schema)


__all__ = ["keep_quality", "longest_repeats", "measure", "quality_rules"]
