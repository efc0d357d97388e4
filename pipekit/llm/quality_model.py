"""Text quality by a convolutional network over bytes, in numpy.

A text is cut into chunks of CHUNK bytes that overlap by OVERLAP and together cover it. Each byte has
a learned vector; learned filters over TAPS bytes are moved over a chunk in steps of STRIDE, and the
largest response of each filter stands for the chunk. The mean and the maximum over the chunks of a
text are combined into one probability. Learning is by gradient steps (Adam) on the driver, from
`sample` labelled rows at most, chosen by a hash of their key; scoring runs in the tasks, over all
bytes of all texts.

Defined results: a null or empty text is one chunk of zero bytes; rows without a usable label are
not learned from, and without any labelled row every score is 0.5; equal rows score alike and are
all returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pipekit.llm.arrays import chosen, extended, flat, sized_batches, texts

CHUNK, OVERLAP = 256, 64
TAPS, STRIDE = 6, 2  # bytes are looked up two at a time, so a step is two
VECTOR, FILTERS = 8, 16
SAMPLE, SAMPLE_BYTES = 3000, 64 * 1024  # rows, and bytes of one text, that are learned from
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.01, 1e-4
PLACES = (CHUNK - TAPS) // STRIDE + 1
SCORED = 128  # chunks at once


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of texts lying one after the other, zeros behind their ends, and whose they are."""
    step = CHUNK - OVERLAP
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-(sizes - OVERLAP) // step))
    of = np.repeat(np.arange(len(sizes)), n)
    start = offsets[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * step
    at = start[:, None] + np.arange(CHUNK)
    inside = at < offsets[of + 1][:, None]
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), of


@dataclass
class Network:
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # TAPS * VECTOR x FILTERS
    shift: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS
    bias: np.ndarray  # 1

    @staticmethod
    def random(seed: int = 1) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        normal = lambda *size, scale: rng.normal(0, scale, size).astype(np.float32)
        filters = normal(TAPS * VECTOR, FILTERS, scale=(TAPS * VECTOR) ** -0.5)
        zeros = np.zeros(FILTERS, np.float32)
        return Network(normal(256, VECTOR, scale=0.5), filters, zeros, normal(2 * FILTERS, scale=0.1), np.zeros(1, np.float32))

    def tables(self) -> list[np.ndarray]:
        """For each two taps, what each two bytes there add to the filters' responses."""
        taps = self.vectors @ self.filters.reshape(TAPS, VECTOR, FILTERS)
        taps[0] += self.shift
        return [(taps[i][:, None] + taps[i + 1][None]).reshape(-1, FILTERS) for i in range(0, TAPS, STRIDE)]

    @staticmethod
    def responses(part: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Chunks x places x filters."""
        pairs = part.view(">u2").astype(np.intp)
        out = tables[0].take(pairs[:, :PLACES], axis=0)
        for i, table in enumerate(tables[1:], 1):
            out += table.take(pairs[:, i : i + PLACES], axis=0)
        return out

    def pooled(self, part: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        out = [np.maximum(self.responses(part[i : i + SCORED], tables).max(axis=1), 0) for i in range(0, len(part), SCORED)]
        return np.concatenate(out) if out else np.zeros((0, FILTERS), np.float32)

    @staticmethod
    def combined(pooled: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Mean and maximum of each text's chunks; the chunks of a text are neighbours."""
        starts = np.searchsorted(of, np.arange(n))
        mean = np.add.reduceat(pooled, starts) / np.bincount(of, minlength=n)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(pooled, starts)], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        n = len(offsets) - 1
        if not n:
            return np.zeros(0)
        part, of = chunks(data, offsets)
        logit = self.combined(self.pooled(part, tables or self.tables()), of, n) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64)))

    def gradients(self, part: np.ndarray, of: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over some texts, for each parameter."""
        n = len(labels)
        answers = self.responses(part, self.tables())
        best = answers.argmax(axis=1)
        pooled = np.take_along_axis(answers, best[:, None], axis=1)[:, 0]
        alive = pooled > 0
        pooled = np.where(alive, pooled, 0)
        both = self.combined(pooled, of, n)
        wrong = ((1 / (1 + np.exp(-np.clip(both @ self.weights + self.bias, -30, 30)))) - labels) / n
        back = wrong[:, None] * self.weights
        count = np.bincount(of, minlength=n)[:, None]
        top = pooled == both[of, FILTERS:]
        ties = np.add.reduceat(top, np.searchsorted(of, np.arange(n))).astype(np.float32)
        grown = (back[:, :FILTERS] / count)[of] + top * (back[:, FILTERS:] / np.maximum(ties, 1))[of]
        grown = (grown * alive).astype(np.float32)
        # Only the places that won carry a gradient.
        at = (best * STRIDE)[:, :, None] + np.arange(TAPS)
        seen = part[np.arange(len(part))[:, None, None], at]
        vectors = self.vectors[seen].reshape(len(part), FILTERS, TAPS * VECTOR)
        filters = np.einsum("cf,cfd->df", grown, vectors)
        to_vectors = (grown[:, :, None] * self.filters.T).reshape(-1, VECTOR)
        own = np.zeros_like(self.vectors)
        np.add.at(own, seen.ravel(), to_vectors)
        return [own, filters, grown.sum(axis=0), both.T @ wrong, wrong.sum(keepdims=True)]


def learned(examples: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network for these texts, the same for the same texts in the same order."""
    network, rng = Network.random(seed), np.random.Generator(np.random.PCG64(seed + 1))
    cut = [chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in examples]
    parameters = [network.vectors, network.filters, network.shift, network.weights, network.bias]
    first, second = ([np.zeros(p.shape) for p in parameters] for _ in range(2))
    step = 0
    network.bias[:] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)) if len(labels) else 0
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        rate = RATE * (1 - epoch / epochs)
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            of = np.repeat(np.arange(len(rows)), [len(cut[r]) for r in rows])
            step += 1
            found = network.gradients(np.concatenate([cut[r] for r in rows]), of, labels[rows])
            for i, (value, gradient) in enumerate(zip(parameters, found)):
                gradient = gradient + DECAY * value
                first[i] = 0.9 * first[i] + 0.1 * gradient
                second[i] = 0.99 * second[i] + 0.01 * gradient**2
                change = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
                value -= (rate * change).astype(np.float32)
    return network


def held_out(key: Column) -> Column:
    """The third of the keys that nothing is learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> Network | None:
    """Learn from `sample` labelled rows at most, with texts of SAMPLE_BYTES at most each."""
    marks = chosen(labels, key=key, label=label).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    marks = marks.where(~held_out(F.col("key"))).orderBy(F.xxhash64("key"), "key", "label").limit(sample)
    rows = chosen(df, key=key, text=text).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    rows = rows.join(F.broadcast(marks), "key")
    rows = rows.orderBy(F.xxhash64("key"), "key", F.xxhash64("text"), "label").limit(sample)
    table = rows.select("text", "label").toArrow()
    if not table.num_rows:
        return None
    return learned(texts(table.column("text")), table.column("label").to_numpy().astype(np.float32))


def score(df: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `score`, the probability of label 1, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for batch in sized_batches(batches, "text", 1024 * 1024):
            scores = network.scores(*flat(batch.column("text")), tables) if network else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores)], ["key", "score"])

    rows = chosen(df, key=key, text=text)
    return rows.mapInArrow(run, extended(rows, ["key"], "score double")).withColumnRenamed("key", key)


__all__ = ["Network", "held_out", "learned", "score", "train"]
