"""Nearest neighbours against a comparison of all pairs."""

import numpy as np
import pytest
from conftest import SF_DIR

from pipekit.llm import neighbours, queries
from pipekit.llm.neighbours import Index, compare, nearest

SCHEMA = "vec_id long, embedding array<float>"


def plain(keys, vectors, k, every):
    """The true neighbours, in order, by key of the query; keys are different."""
    out = {}
    for i in np.flatnonzero(keys % every == 0):
        scores = np.where(keys == keys[i], -np.inf, (vectors[i] * vectors).sum(axis=1))
        order = np.lexsort([keys, -scores])[: min(k, len(keys) - 1)]
        out[int(keys[i])] = [(int(keys[j]), float(scores[j])) for j in order]
    return out


def answers(found):
    out = {}
    for row in sorted(found.collect(), key=lambda r: (r[0], r[1])):
        assert row[1] == len(out.setdefault(row[0], [])) + 1
        out[row[0]].append((row[2], row[3]))
    return out


def recall(found, true):
    assert set(found) == set(true)
    hits = [len({k for k, _ in found[q]} & {k for k, _ in true[q]}) for q in true]
    assert all(len(found[q]) == len(true[q]) for q in true)
    return sum(hits) / sum(map(len, true.values()))


@pytest.mark.parametrize("folder", [SF_DIR, SF_DIR.replace("0.001", "0.1")])
def test_query(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    keys, vectors = table.vec_id.to_numpy(), np.stack(table.embedding).astype(np.float64)
    found = answers(queries.QUERIES["op11_neighbours"](spark, folder))
    assert recall(found, plain(keys, vectors, 20, 20)) >= 0.9
    at = {int(key): i for i, key in enumerate(keys)}
    for query, own in found.items():
        assert all(score == (vectors[at[query]] * vectors[at[key]]).sum() for key, score in own)
        assert own == sorted(own, key=lambda one: (-one[1], one[0]))


def made(seed, n, width, copies=0):
    r = np.random.default_rng(seed)
    vectors = r.standard_normal((n, width)) * r.uniform(0.2, 3, (n, 1))  # lengths differ
    vectors[: copies] = vectors[0]
    return np.arange(n), vectors.astype(np.float32).astype(np.float64)


def test_lengths_copies_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 100 * 8 * 6)  # several parts of a leaf and of the queries
    monkeypatch.setattr(neighbours, "CELLS", 1000)
    keys, vectors = made(1, 3000, 6, copies=1000)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, vectors)], SCHEMA).repartition(7)
    true = plain(keys, vectors, 5, 10)
    assert recall(answers(nearest(df, k=5, every=10)), true) >= 0.9
    whole = answers(nearest(df, k=5, every=10, recall=1.0))
    assert recall(whole, true) >= 0.98


def test_compare_is_exact_within_the_leaves_visited():
    keys, vectors = made(2, 400, 4, copies=60)
    vectors[100:160] = np.eye(4)[np.arange(60) % 4]  # many ties
    leaf = (np.arange(400) % 7).astype(np.int32)
    leaf[:60] = 3
    asked = np.concatenate([vectors[:40], np.eye(4)])
    visits = [np.array(sorted({i % 7, 3})) for i in range(len(asked))]
    query, key, score = compare(asked, visits, keys, vectors, leaf, 9)
    for i, own in enumerate(visits):
        here = np.isin(leaf, own)
        scores = (asked[i] * vectors[here]).sum(axis=1)
        order = np.lexsort([keys[here], -scores])[:9]
        assert key[query == i].tolist() == keys[here][order].tolist()
        assert np.allclose(score[query == i], scores[order])


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [])]
    rows += [(7, [2.0]), (0, [1.0, 0.0]), (None, [9.0, 9.0]), (8, [1.0, 0.0]), (9, [1.0, -0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", key string, rank int, leaf int")
    found = answers(nearest(df, every=4))
    assert found == {
        0: [(7, 2.0), (8, 1.0), (9, 1.0), (1, 0.5)],
        8: [(7, 2.0), (0, 1.0), (9, 1.0), (1, 0.5)],
    }
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 4"), df.where("vec_id = 0")):
        assert nearest(none).count() == 0


def test_tree_holds_every_row_and_queue_goes_by_distance(spark):
    keys, vectors = made(3, 2000, 8)
    index = Index(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, vectors)], SCHEMA))
    assert index.sizes.sum() == 2000 and len(index.tree.leaf) > 10
    distances = index.tree.distances(neighbours.asked(vectors[:1], index.norm))[0]
    order = list(index.tree.best_first(distances.tolist()))
    assert sorted(order) == list(range(len(index.tree.leaf)))
    node = {leaf: n for n, leaf in index.tree.leaf.items()}
    assert distances[node[order[0]]] <= np.median(distances)
