"""Whitening of vectors by slices of the covariance's spectrum.

Three passes find the sums, the centred covariance and, at the end, how far the whitened vectors are
from an identity covariance. The eigenvalues of the covariance V are counted, not listed: the inertia
of V - sI, from an LDL^T factorisation with pivots of one and two rows, says how many are above s.
Bisection on these counts isolates each leading eigenvalue, Rayleigh quotient iteration from inside
its interval converges to it cubically, and two more counts beside the result certify its number.

Entries are made integers, x = floor(64 c) + 1000000, so that counts, sums and deviations are exact.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; shorter
vectors count as followed by zeros; an entry beyond +-2^40 after scaling counts as that bound; equal
rows are all returned, and null keys too; components without variance (less than 1e-11 of the
largest) are left out, so vectors that are all alike, and an empty table, give no rows; a deviation
that does not fit a long is null; other columns are ignored.

The driver holds sums and covariances, whose size is that of the vectors' dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pipekit.llm.arrays import chosen, extended
from pipekit.llm.vectors import lists, matrix

SCALE, OFFSET, BOUND = 64, 1_000_000, 2**40
COMPONENTS = 32
ROUNDING = 1e-14  # of the largest eigenvalue
NO_VARIANCE = 1e-11
PIVOT = (1 + 17**0.5) / 8  # a single pivot is taken if it is so large beside the others


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors), -BOUND, BOUND).astype(np.int64) + OFFSET


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above `shift`: the positive pivots of LDL^T."""
    rest = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(rest):
        size, diagonal = np.abs(rest), np.abs(rest.diagonal())
        top = int(diagonal.argmax())
        p, q = divmod(int(size.argmax()), len(rest))
        if size[p, q] == 0:
            break
        if p == q or diagonal[top] >= PIVOT * size[p, q]:
            pivot, column = rest[top, top], rest[:, top]
            positive += bool(pivot > 0)
            rest = rest - np.outer(column, column / pivot)
            left = np.arange(len(rest)) != top
        else:
            pair = [p, q]  # its determinant is negative: one eigenvalue of either sign
            positive += 1
            columns = rest[:, pair]
            rest = rest - columns @ np.linalg.solve(rest[np.ix_(pair, pair)], columns.T)
            left = ~np.isin(np.arange(len(rest)), pair)
        rest = rest[np.ix_(left, left)]
        rest = (rest + rest.T) / 2
    return positive


class Spectrum:
    """The leading eigenpairs of a symmetric matrix, by number."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        reach = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
        self.counts = {-reach - 1.0: len(matrix), reach * (1 + 1e-9): 0}  # eigenvalues above, by shift
        self.reach = reach
        self.values: list[float] = []
        self.vectors = np.zeros((len(matrix), 0))

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.matrix, shift)
        return self.counts[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The closest shifts so far with the eigenvalue of that number between them."""
        low = max(s for s, n in self.counts.items() if n >= number)
        return low, min((s for s, n in self.counts.items() if n < number and s > low), default=low)

    def isolated(self, number: int, narrow: float) -> tuple[float, float]:
        """An interval without other eigenvalues, or one no wider than `narrow`."""
        while True:
            low, high = self.interval(number)
            alone = self.counts[low] == number and self.counts.get(high, number) == number - 1
            middle = (low + high) / 2
            if alone or high - low <= narrow or not low < middle < high:
                return low, high
            self.above(middle)

    def solve(self, shift: float, vector: np.ndarray) -> np.ndarray:
        for _ in range(8):
            try:
                found = np.linalg.solve(self.matrix - shift * np.eye(len(vector)), vector)
                if np.isfinite(found).all():
                    break
            except np.linalg.LinAlgError:
                pass
            shift += ROUNDING * self.reach
        for _ in range(2):
            found = found - self.vectors @ (self.vectors.T @ found)
        return found / np.linalg.norm(found)

    def iterate(self, low: float, high: float, seed: int) -> tuple[float, np.ndarray, float]:
        """Eigenvalue, vector and residual that the iteration from inside the interval comes to."""
        vector = np.random.default_rng(seed).standard_normal(len(self.matrix))
        shift = (low + high) / 2
        for _ in range(3):
            vector = self.solve(shift, vector)
        best = None
        for _ in range(12):
            image = self.matrix @ vector
            value = float(vector @ image)
            residual = float(np.linalg.norm(image - value * vector))
            if best is not None and residual >= best[2] / 2:
                return min(best, (value, vector, residual), key=lambda found: found[2])
            best = value, vector, residual
            # Outside its interval the quotient is on its way to another eigenvalue.
            vector = self.solve(value if low <= value <= high else shift, vector)
        return best

    def add(self) -> None:
        """Find the next eigenpair, by falling eigenvalue."""
        number, narrow = len(self.values) + 1, self.reach
        while True:
            low, high = self.isolated(number, narrow)
            value, vector, residual = self.iterate(low, high, number)
            margin = max(4 * residual, ROUNDING * self.reach)
            certified = self.above(value + margin) < number <= self.above(value - margin)
            tight = high - low <= ROUNDING * self.reach
            if certified and residual <= 1e3 * ROUNDING * self.reach or tight:
                break
            narrow = (high - low) / 16
            low, high = self.interval(number)
            self.above((low + high) / 2)
        self.values.append(value)
        vector = vector * np.sign(vector[np.abs(vector).argmax()])
        self.vectors = np.concatenate([self.vectors, vector[:, None]], axis=1)


def eigenpairs(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues with variance, `most` at most, falling, and their unit vectors as columns."""
    spectrum = Spectrum(covariance)
    while len(spectrum.values) < min(most, len(covariance)) and spectrum.reach:
        floor = NO_VARIANCE * (spectrum.values[0] if spectrum.values else np.trace(covariance) / len(covariance))
        if spectrum.above(floor) <= len(spectrum.values):
            break
        spectrum.add()
    return np.array(spectrum.values), spectrum.vectors


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their sum by dimension, from one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, np.int64)
        for batch in batches:
            places, vectors = matrix(batch.column("vector"))
            wide = max(len(sums), vectors.shape[1])
            # A dimension that a vector lacks is a zero there.
            here = np.full(wide, OFFSET * len(places), np.int64)
            here[: vectors.shape[1]] = integers(vectors).sum(axis=0)
            sums = np.concatenate([sums, np.full(wide - len(sums), OFFSET * n, np.int64)]) + here
            n += len(places)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "sums": pa.array([[n, *sums]], pa.list_(pa.int64()))})

    tasks = rows.select("vector").mapInArrow(run, "n long, sums array<long>")
    by_place = tasks.select("n", F.posexplode("sums").alias("place", "x")).groupBy("place")
    found = by_place.agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    places = found.orderBy("place").collect()
    total = int(places[0].x) if places else 0
    # Tasks that met no vector with a dimension have zeros there.
    return total, [int(r.x) + OFFSET * (total - r.n) for r in places[1:]] if total else []


def _products(rows: DataFrame, width: int, of) -> np.ndarray:
    """The sum over all rows of the outer product of `of(vectors)`, rows of `width` doubles, with themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            centred = of(batch.column("vector"))
            total += centred.T @ centred
        yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(width, dtype=np.int32)), "products": lists(total)})

    tasks = rows.select("vector").mapInArrow(run, "row int, products array<double>")
    cells = tasks.select("row", F.posexplode("products").alias("column", "x")).groupBy("row", "column").agg(F.sum("x").alias("x"))
    found = cells.toArrow()
    out = np.zeros((width, width))
    out[np.asarray(found["row"]), np.asarray(found["column"])] = np.asarray(found["x"])
    return (out + out.T) / 2


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """`key`, `component` from 1, `n`, `deviation`, `whitened`, `explained` and `identity_error`.

    A row for each vector and component; passes over the table are run when this is called.
    """
    rows = chosen(df, key=key, vector=vector)
    n, sums = _sums(rows)
    width = len(sums)
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the nearest integer to each mean
    left = np.array([s - n * int(r) for s, r in zip(sums, near)], np.int64)

    def centred(column: pa.Array) -> np.ndarray:
        return (integers(matrix(column, width)[1]) - near) - left / n

    values, vectors = np.zeros(0), np.zeros((width, 0))
    explained, error = values, 0.0
    if n:
        covariance = _products(rows, width, centred) / n
        values, vectors = eigenpairs(covariance, components)
        explained = values / np.trace(covariance) if len(values) else values
    project = vectors / np.sqrt(values)
    if len(values):
        whole = _products(rows, len(values) + 1, lambda c: np.pad(centred(c) @ project, ((0, 0), (0, 1)), constant_values=1.0)) / n
        means = whole[-1, :-1]
        error = float(np.abs(whole[:-1, :-1] - np.outer(means, means) - np.eye(len(values))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(values):
                return
            places, own = matrix(batch.column("vector"), width)
            apart = integers(own) - near
            far = apart.astype(np.float64) * n - left
            fits = (far**2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            exact = ((apart * n - left) ** 2).sum(axis=1)  # where it fits, nothing on the way overflows
            columns = [
                batch.column("key").take(pa.array(places)),
                pa.array(exact, mask=~fits),
                lists((apart - left / n) @ project),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "deviation", "whitened"])

    done = rows.mapInArrow(run, extended(rows, ["key"], "deviation long, whitened array<double>"))
    done = done.select("key", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    shares = F.array(*[F.lit(float(x)) for x in explained]) if len(values) else F.array().cast("array<double>")
    return done.select(
        F.col("key").alias(key),
        (F.col("component") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


__all__ = ["Spectrum", "count_above", "eigenpairs", "integers", "whiten"]
