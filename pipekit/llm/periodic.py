"""Periodic runs of words: stretches that repeat with a period, and texts without the repeats.

A run is a stretch of words with smallest period q and at least max(12, 2 q) words, which no
neighbouring word extends. Words q apart that agree lie on the diagonal of lag q; a run is a piece of
a diagonal with at least max(12 - q, q) agreeing words in a row. The words of a text are read once
from left to right for each range of lags, [1, 12), [12, 24), [24, 48) and so on. Each word looks up
its earlier occurrences in the range, prolongs the diagonals that are active, opens those that begin
there, and ends the others, which emit their run at once.

The table is sparse. Every diagonal long enough holds a window of as many words as the range's least
lag (6 in the first), so occurrences are those of the window that begins at the word, and a text
without a repeated window is done. A second window, where the required length ends, tells a new
diagonal that will be long enough from one that won't. Occurrences after the same word go on and are
not new; a diagonal that begins where a run with a divisor of its lag began is that run again. So the
work is about words times number of ranges, whatever repeats.

Defined results: a null or empty text has no words and no runs; equal rows are all returned; an empty
table gives an empty table; other columns are ignored. Texts are worked on whole, with some 300 bytes
a word at most.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pipekit.llm.arrays import chosen, covered, extended, sized_batches, texts

SHORTEST = 12  # words of a run
WINDOW = 6  # a run of lag q has max(12 - q, q) agreeing words, 6 at least
RUN = "struct<start: long, length: long, period: long>"


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both parts are."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _repeated(windows: np.ndarray) -> np.ndarray:
    """Which windows stand at several places."""
    return np.bincount(windows)[windows] > 1


def _scan(windows: np.ndarray, size: int, low: int, high: int, runs: dict[tuple[int, int], int]) -> None:
    """Add the runs with periods in [low, high) to `runs`: period by start and end.

    `windows[i]` names the `size` words from i on; `runs` holds those with shorter periods.
    """
    order = np.argsort(windows, kind="stable")
    near = (windows[order[1:]] == windows[order[:-1]]) & (order[1:] - order[:-1] < high)
    if not near.any():
        return
    # Words whose window stands close by: the others end all diagonals, and no later word looks for them.
    places = np.unique(np.concatenate([order[1:][near], order[:-1][near]])).tolist()
    names = windows.tolist()
    shorter: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (start, end), period in runs.items():
        shorter[start].append((end, period))
    seen: dict[int, dict[int, list[int]]] = defaultdict(dict)
    active: dict[int, int] = {}  # start of the run by lag
    last = -1

    def emit(lags: list[int]) -> None:
        end = last + size
        for lag in lags:
            start = active.pop(lag)
            if runs.get((start, end), lag) >= lag:
                runs[start, end] = lag

    for i in places:
        name = names[i]
        if i != last + 1:
            emit(list(active))
        elif active:
            emit([lag for lag in active if names[i - lag] != name])
        last = i
        before = names[i - 1] if i else -1
        occurrences = seen[name]
        for other in list(occurrences):
            at = occurrences[other]
            if i - at[-1] >= high:  # too far, from here on
                del occurrences[other]
                continue
            if other == before and i:
                continue
            for j in reversed(at):
                lag = i - j
                if lag >= high:
                    break
                if lag < low:
                    continue
                ahead = max(SHORTEST - lag, lag) - size
                if i + ahead >= len(names) or names[i + ahead] != names[j + ahead]:
                    continue
                again = any(end >= i + size and lag % period == 0 for end, period in shorter.get(j, ()))
                if not again and not any(start == j and lag % period == 0 for period, start in active.items()):
                    active[lag] = j
        occurrences.setdefault(before, []).append(i)
    emit(list(active))


def periodic_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period; equal numbers are equal words."""
    n = len(words)
    if n < SHORTEST:
        return []
    _, words = np.unique(words, return_inverse=True)
    size = WINDOW
    pairs = _paired(words[:-1], words[1:])
    windows = _paired(_paired(pairs[:-4], pairs[2:-2]), pairs[4:])
    runs: dict[tuple[int, int], int] = {}
    low = 1
    while _repeated(windows).any():
        _scan(windows, size, low, 2 * size, runs)
        low = 2 * size
        if 2 * low > n:
            break
        windows = _paired(windows[:-size], windows[size:])
        size = low
    found = [(start, end - start, period) for (start, end), period in runs.items()]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those outside all runs, or among the first period of words of every run they are in."""
    if not runs:
        return np.ones(n, bool)
    starts, lengths, periods = np.array(runs, np.int64).T
    return ~covered(starts + periods, starts + lengths, n)


def _suspects(numbers: list[np.ndarray]) -> np.ndarray:
    """Which texts have a window twice, from one sort of hashes over all of them; unlike ones may be among them."""
    sizes = np.array([len(own) for own in numbers], np.int64)
    out = np.zeros(len(numbers), bool)
    words = np.concatenate([np.zeros(0, np.int64), *numbers]).astype(np.uint64)
    if len(words) < SHORTEST:
        return out
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = text[: len(words) - WINDOW + 1].astype(np.uint64)
    for k in range(WINDOW):
        key = (key ^ words[k : len(words) - WINDOW + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    inside = text[: len(key)] == text[WINDOW - 1 :]
    key, text = key[inside], text[: len(inside)][inside]
    order = np.argsort(key)
    twice = key[order[1:]] == key[order[:-1]]
    out[text[order[1:][twice]]] = True
    return out


def mark_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_words`, `runs` (by start and period) and `collapsed`, the words that stay, joined by spaces.

    Words are runs of bytes other than space and 0x09-0x0D.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            number: dict[bytes, int] = defaultdict(count().__next__)
            split = [own.split() for own in texts(batch.column("text"))]
            numbers = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in split]
            found: list[list[tuple[int, int, int]]] = [[] for _ in split]
            kept = [b" ".join(words) for words in split]
            for i in np.flatnonzero(_suspects(numbers)).tolist():
                found[i] = periodic_runs(numbers[i])
                if found[i]:
                    stay = np.flatnonzero(collapsed(len(split[i]), found[i])).tolist()
                    kept[i] = b" ".join([split[i][k] for k in stay])
            runs = [[dict(zip(("start", "length", "period"), one)) for one in own] for own in found]
            kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
            columns = [
                batch.column("key"),
                pa.array([len(words) for words in split], pa.int64()),
                pa.array(runs, kind),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    rows = chosen(df, key=key, text=text)
    schema = extended(rows, ["key"], f"n_words long, runs array<{RUN}>, collapsed string")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


__all__ = ["collapsed", "mark_runs", "periodic_runs"]
