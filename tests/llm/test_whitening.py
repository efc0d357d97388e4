"""Whitening against numpy's eigenvalues and exact integers."""

import numpy as np
import pytest
from conftest import SF_DIR

from pipekit.llm import queries
from pipekit.llm.whitening import count_above, eigenpairs, whiten


def covariances():
    r = np.random.default_rng(4)
    for size in (1, 2, 7, 40):
        a = r.standard_normal((3 * size, size))
        yield a.T @ a / len(a)
        scales = 10.0 ** np.linspace(0, 4, size)
        yield a.T @ a * np.outer(scales, scales)
    turn = np.linalg.qr(r.standard_normal((8, 8)))[0]
    tied = turn @ np.diag([5, 5, 5, 3, 3, 1, 1, 1.0]) @ turn.T
    yield (tied + tied.T) / 2
    yield np.eye(5)
    low = r.standard_normal((30, 3)) @ r.standard_normal((3, 12))
    yield low.T @ low / 30


@pytest.mark.parametrize("matrix", list(covariances()))
def test_eigenpairs(matrix):
    values, vectors = eigenpairs(matrix, 32)
    known = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == min(32, int((known > 1e-11 * known[0]).sum()))
    assert np.allclose(values, known[: len(values)], rtol=1e-9, atol=1e-13 * known[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * known[0])


def test_inertia_of_indefinite_matrices():
    r = np.random.default_rng(5)
    for size in (1, 2, 3, 10, 33):
        a = r.standard_normal((size, size))
        a = a + a.T
        a[np.diag_indices(size)] *= r.integers(0, 2)  # zero diagonals need pivots of two rows
        for shift in (-1.0, 0.0, 0.3, 2.0):
            assert count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert count_above(np.zeros((4, 4)), 0.0) == 0


def expected(vectors):
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    values, turned = np.linalg.eigh(np.cov(x.T, bias=True))
    values, turned = values[::-1][:32], turned[:, ::-1][:, :32]
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return n, deviation, (x - sums / n) @ turned / np.sqrt(values), values / np.cov(x.T, bias=True).trace()


def test_query(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, whitened, explained = expected(np.stack(table.embedding).astype(np.float64))
    found = queries.QUERIES["op13_whitening"](spark, SF_DIR).toPandas()
    assert set(found.n) == {n} and set(found.component) == set(range(1, 33)) and len(found) == 32 * n
    by = found.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    signs = np.sign((by * whitened).sum(axis=0))
    assert np.allclose(by, whitened * signs, atol=1e-8)
    assert np.allclose(by.T @ by / n, np.eye(32), atol=1e-9)
    first = found[found.component == 1].set_index("vec_id").loc[table.vec_id]
    assert first.deviation.tolist() == deviation.tolist()
    assert np.allclose(found[found.vec_id == 0].sort_values("component").explained, explained, rtol=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [nan, 1.0]), (5, []), (6, [3.0]), (8, [inf])]
    rows += [(1, [1.0, 2.0]), (None, [0.5, -7.25])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, key string, n int")
    found = whiten(df).toPandas()
    kept = np.array([[1, 2], [0, 0], [3, 0], [1, 2], [0.5, -7.25]], float)
    n, deviation, whitened, explained = expected(kept)
    assert set(found.n) == {5} and len(found) == 10
    assert sorted(found.deviation) == sorted([*deviation, *deviation])
    assert np.allclose(sorted(abs(found.whitened)), sorted(abs(whitened).reshape(-1)), atol=1e-9)
    assert np.allclose(sorted(set(found.explained)), sorted(explained))
    for empty in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 5"), df.where("vec_id = 3")):
        assert whiten(empty).count() == 0 and whiten(empty).columns == found.columns.tolist()


def test_far_entries(spark):
    rows = [(i, [1e30 * (-1) ** i, float(i)]) for i in range(6)]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert found.deviation.isna().all()  # it fits no long
    assert np.isfinite(found.whitened).all() and found.identity_error.max() < 1e-4
