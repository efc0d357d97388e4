"""Nearest neighbours by inner product through a hierarchical k-means tree.

The tree is fitted on a sample of the vectors; every vector is then put into one of its leaves. So
that nearness is a distance, each vector gets one more coordinate that lifts it to the largest norm
M, and a query a zero: among vectors of one norm the least distance is the largest inner product.

A query goes through the tree best bin first: a priority queue holds the nodes met and not yet
opened by the distance of their centres, and the closest is opened next, until enough leaves are
visited. How many are enough is calibrated: for a sample of the queries the true neighbours are found
by comparing them with all rows, and visits are widened until the leaves visited hold the wanted part
of these neighbours.

Leaves lie in blocks of bounded size, a large leaf in several; a query is sent once to each block with
a leaf it visits, and queries and rows of a block meet in groups of bounded size. Copies of a vector in
a group are compared once, and of their keys the k + 1 smallest go on, which no result can exceed.

Defined results: vectors that are null, zero or hold null or non-finite entries, and rows without a
key, take no part; shorter vectors count as followed by zeros; rows alike in key and vector count as
one; a key with several vectors is as many candidates, and as a query it asks for what is nearest to
any of them; its own rows are never its neighbours; ties go to smaller keys; with no more than k
candidates all are returned; an empty table, or one row, gives no rows; other columns are ignored.

The driver holds the tree, sizes of leaves, the samples and the neighbours of the sampled queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pipekit.llm.arrays import chosen
from pipekit.llm.vectors import matrix
from pipekit.session import saved

NEIGHBOURS, EVERY, RECALL = 20, 20, 0.95
SAMPLE, BRANCHES, LEAF, ROUNDS, SEED = 16_384, 16, 96, 12, 42  # the fit: vectors, and of them in a leaf
PROBES = 256  # queries that visits are calibrated on
BLOCK_BYTES, BLOCKS = 32 * 1024 * 1024, 16  # most bytes of a block as doubles; least number of blocks
CELLS = 4 * 1024 * 1024  # scores held at once
HASHES = 2**32


def _clusters(vectors: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """BRANCHES centres at most, by Lloyd's rounds."""
    centres = vectors[rng.choice(len(vectors), min(BRANCHES, len(vectors)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        sizes = np.bincount(own, minlength=len(centres))
        centres = sums[sizes > 0] / sizes[sizes > 0][:, None]
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


class Tree:
    """Nodes by number, 0 the root: their centres, their children (none: a leaf) and the leaves' numbers."""

    def __init__(self, sample: np.ndarray):
        rng = np.random.default_rng(SEED)
        centres, self.children, self.leaf = [np.zeros(sample.shape[1])], [[]], {}
        todo = [(0, sample)]
        while todo:
            node, own = todo.pop()
            split = _clusters(own, rng) if len(own) > LEAF else own[:0]
            if len(split) < 2:
                self.leaf[node] = len(self.leaf)
                continue
            of = _nearest(own, split)
            for k, centre in enumerate(split):
                self.children[node].append(len(centres))
                todo.append((len(centres), own[of == k]))
                centres.append(centre)
                self.children.append([])
        self.centres = np.array(centres)

    def leaves(self, lifted: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the closest child, down from the root."""
        out = np.zeros(len(lifted), np.int32)
        todo = [(0, np.arange(len(lifted)))]
        while todo:
            node, rows = todo.pop()
            children = self.children[node]
            if not children:
                out[rows] = self.leaf[node]
            elif len(rows):
                of = _nearest(lifted[rows], self.centres[children])
                todo += [(child, rows[of == k]) for k, child in enumerate(children)]
        return out

    def distances(self, asked: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(axis=1) - 2 * asked @ self.centres.T

    def best_first(self, distances: list[float]) -> Iterator[int]:
        """The leaves in the order of the priority queue; `distances` are those of all nodes."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            children = self.children[node]
            if not children:
                yield self.leaf[node]
            for child in children:
                heapq.heappush(queue, (distances[child], child))


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors of at most this norm with one more coordinate that makes it their norm."""
    rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def asked(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Queries at the same norm, with a zero for the further coordinate."""
    sizes = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.concatenate([vectors * (norm / sizes), np.zeros((len(vectors), 1))], axis=1)


def _distinct(vectors: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """For each row a number, the same for rows alike in vector and `more`."""
    parts = np.concatenate([vectors + 0.0, *[m[:, None].astype(np.float64) for m in more]], axis=1)
    parts = np.ascontiguousarray(parts)
    return np.unique(parts.view(np.dtype((np.void, parts.shape[1] * 8))).reshape(-1), return_inverse=True)[1]


def _best(of: np.ndarray, scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each `of`, by falling score and then key, in that order."""
    order = np.lexsort([keys, -scores, of])
    of = of[order]
    head = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
    place = np.arange(len(of))
    return order[place - np.maximum.accumulate(np.where(head, place, 0)) < k]


def _products(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, always added in the same order."""
    step = max(1, CELLS // max(1, left.shape[1]))
    parts = [(left[a[i : i + step]] * right[b[i : i + step]]).sum(axis=1) for i in range(0, len(a), step)]
    return np.concatenate([np.zeros(0), *parts])


def compare(
    queries: np.ndarray, visits: list[np.ndarray], keys: np.ndarray, vectors: np.ndarray, leaf: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, keys and scores: for each query the k best rows of the leaves it visits, ties by key."""
    of = _distinct(vectors, leaf)
    by = np.lexsort([keys, of])
    heads = np.flatnonzero(np.concatenate([[True], of[by][1:] != of[by][:-1]])) if len(by) else np.zeros(0, np.int64)
    copies = np.diff(np.append(heads, len(by)))
    first = by[heads]  # of each vector the row with the smallest key
    norms = np.sqrt((queries**2).sum(axis=1)) * np.sqrt((vectors**2).sum(axis=1).max(initial=0))
    slack = 1e-12 * norms
    limit = np.full(len(queries), -np.inf)
    kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, vector, score
    visitors: dict[int, list[int]] = {}
    for query, leaves in enumerate(visits):
        for own in leaves.tolist():
            visitors.setdefault(own, []).append(query)
    for own, members in visitors.items():
        here = np.flatnonzero(leaf[first] == own)
        step = max(1, CELLS // max(1, len(here)))
        for start in range(0, len(members) if len(here) else 0, step):
            some = np.array(members[start : start + step])
            scores = queries[some] @ vectors[first[here]].T
            bound = limit[some]
            if len(here) > k:
                bound = np.maximum(bound, np.partition(scores, len(here) - k, axis=1)[:, len(here) - k])
            a, b = np.nonzero(scores >= (bound - slack[some])[:, None])
            query, vector = some[a], here[b]
            exact = _products(queries, vectors, query, first[vector])
            # Only the queries of this step can have changed.
            apart = np.isin(kept[0], some)
            merged = [np.concatenate([old[apart], new]) for old, new in zip(kept, (query, vector, exact))]
            stay = _best(merged[0], merged[2], keys[first[merged[1]]], k)
            merged = [part[stay] for part in merged]
            full = np.bincount(merged[0], minlength=len(queries)) >= k
            worst = np.full(len(queries), np.inf)
            np.minimum.at(worst, merged[0], merged[2])
            limit = np.where(full, worst, limit)
            kept = tuple(np.concatenate([old[~apart], new]) for old, new in zip(kept, merged))
    query, vector, score = kept
    # The copies of each vector, the smallest keys first.
    many = np.minimum(copies[vector], k)
    at = np.repeat(heads[vector], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    query, score, key = np.repeat(query, many), np.repeat(score, many), keys[by[at]]
    best = _best(query, score, key, k)
    return query[best], key[best], score[best]


def _ranges(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each leaf: small leaves share blocks, large ones are split."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, held = 0, 0
    for leaf, size in enumerate(sizes.tolist()):
        if held and held + size > rows:
            block, held = block + 1, 0
        first[leaf], parts[leaf] = block, max(1, -(-size // rows))
        held += size
        if parts[leaf] > 1:
            block, held = block + int(parts[leaf]), 0
    return first, parts


def _sampled(rows: DataFrame, n: int, wanted: int, seed: int) -> DataFrame:
    """About `wanted` of the n rows, all if there are no more; by a hash, so that they are always the same."""
    share = min(1.0, wanted / n)
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "key", "vector"), F.lit(HASHES)) < int(share * HASHES))


def nearest(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    every: int = EVERY,
    recall: float = RECALL,
) -> DataFrame:
    """`query`, `rank`, `key` and `score`: the k nearest found of each row whose key is divisible by `every`.

    The table is written once without repeated rows, and the tree fitted and calibrated, when this is called.
    """
    index = Index(df, key, vector)
    return index.search(F.col("key") % every == 0, k, recall)


class Index:
    """The rows that take part, as a written table, and the tree over them."""

    def __init__(self, df: DataFrame, key: str = "vec_id", vector: str = "embedding"):
        rows = chosen(df, key=key, vector=vector).where("key IS NOT NULL").withColumn("key", F.col("key").cast("long"))

        def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, own = matrix(batch.column("vector"))
                yield batch.take(pa.array(places[own.any(axis=1)]))

        self.rows = saved(rows.mapInArrow(valid, rows.schema).dropDuplicates(["key", "vector"]), "vectors")

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, own = matrix(batch.column("vector"))
                norm = float((own**2).sum(axis=1).max(initial=0))
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "width": [own.shape[1]], "norm": [norm]})

        facts = self.rows.mapInArrow(measured, "n long, width long, norm double")
        n, width, norm = facts.agg(F.sum("n"), F.max("width"), F.max("norm")).first()
        self.n, self.width, self.norm = n or 0, width or 0, (norm or 0.0) ** 0.5
        if not self.n:
            return
        sample = _sampled(self.rows, self.n, SAMPLE, 1).select("vector").toArrow()["vector"]
        _, sample = matrix(sample, self.width)
        # A vector with many copies counts once.
        order = np.unique(_distinct(sample), return_index=True)[1]
        self.tree = Tree(lifted(sample[order], self.norm))
        sizes = self.placed().groupBy("leaf").count().collect()
        self.sizes = np.zeros(len(self.tree.leaf), np.int64)
        for row in sizes:
            self.sizes[row["leaf"]] = row["count"]

    def placed(self) -> DataFrame:
        """The rows with their leaf."""
        tree, width, norm = self.tree, self.width, self.norm

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.leaves(lifted(matrix(batch.column("vector"), width)[1], norm))
                yield batch.append_column("leaf", pa.array(leaf))

        kind = self.rows.schema["vector"].dataType.simpleString()
        return self.rows.mapInArrow(run, f"key long, vector {kind}, leaf int")

    def neighbours_of(self, keys: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
        """`query` (its number), `key`, `score`, `leaf`: the true neighbours, by comparing with all rows."""
        tree, width, norm = self.tree, self.width, self.norm

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, own = matrix(batch.column("vector"), width)
                names, leaf = np.asarray(batch.column("key")), tree.leaves(lifted(own, norm))
                everywhere = [np.zeros(1, np.int32)] * len(vectors)
                # One place more, as a query's own row is left out.
                found = compare(vectors, everywhere, np.arange(len(own)), own, np.zeros(len(own), np.int32), k + 1)
                query, at, score = found
                other = names[at] != keys[query]
                columns = query[other], names[at][other], score[other], leaf[at][other]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "key", "score", "leaf"])

        return self.rows.mapInArrow(run, "query long, key long, score double, leaf int")

    def visits(self, asking: Column, k: int, recall: float) -> int:
        """The leaves to visit so that of a sample of queries this part of the true neighbours is found."""
        wanted = self.rows.where(asking)
        number = wanted.count()
        if not number or len(self.tree.leaf) == 1:
            return 1
        probes = _sampled(wanted, number, PROBES, 2).toArrow()
        keys, vectors = np.asarray(probes["key"]), matrix(probes["vector"], self.width)[1]
        if not len(keys):
            return len(self.tree.leaf)
        near = self.neighbours_of(keys, vectors, k)
        true = near.groupBy("query").agg(
            F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "key", "leaf"))), 1, k).alias("near")
        )
        found = true.select("query", F.col("near.leaf").alias("leaf")).collect()
        distances = self.tree.distances(asked(vectors, self.norm)).tolist()
        places: list[int] = []  # of each true neighbour's leaf in the order of the query
        for row in found:
            order = {leaf: place for place, leaf in enumerate(self.tree.best_first(distances[row["query"]]))}
            places += [order[leaf] for leaf in row["leaf"]]
        widened, held = 0, 0
        by_place = np.bincount(places, minlength=len(self.tree.leaf))
        while held < recall * len(places):
            held += by_place[widened]
            widened += 1
        return max(widened, 1)

    def search(self, asking: Column, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
        """`query`, `rank`, `key`, `score` for the rows chosen by `asking`, a condition on `key`."""
        spark, result = self.rows.sparkSession, "query long, rank int, key long, score double"
        if not self.n:
            return spark.createDataFrame([], result)
        tree, width, norm, sizes = self.tree, self.width, self.norm, self.sizes
        visits = self.visits(asking, k, recall)
        most = max(1, BLOCK_BYTES // (8 * max(1, width)))  # rows
        first, parts = _ranges(sizes, min(most, max(1024, -(-self.n // BLOCKS))))
        queries = self.rows.where(asking)
        turns = max(1, -(-queries.count() // most))  # parts of the queries

        def turn(seed: int) -> Column:
            return F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(turns)).cast("int")

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query to the blocks of its leaves."""
            for batch in batches:
                own = matrix(batch.column("vector"), width)[1]
                rows, blocks, visited = [], [], []
                for row, distances in enumerate(tree.distances(asked(own, norm)).tolist()):
                    to: dict[int, list[int]] = {}
                    opened = seen = 0
                    for leaf in tree.best_first(distances):
                        # On until there are enough leaves, and k rows beside the query's own.
                        if opened >= visits and seen > k:
                            break
                        opened, seen = opened + 1, seen + int(sizes[leaf])
                        for block in range(int(first[leaf]), int(first[leaf] + parts[leaf])):
                            to.setdefault(block, []).append(leaf)
                    rows += [row] * len(to)
                    blocks += to
                    visited += to.values()
                sent = batch.take(pa.array(rows, pa.int64()))
                sent = sent.append_column("block", pa.array(blocks, pa.int32()))
                yield sent.append_column("leaves", pa.array(visited, pa.list_(pa.int32())))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each row to its block."""
            for batch in batches:
                leaf = np.asarray(batch.column("leaf"))
                block = first[leaf] + np.asarray(batch.column("part")) % parts[leaf]
                yield batch.append_column("block", pa.array(block.astype(np.int32))).drop_columns(["part"])

        kind = self.rows.schema["vector"].dataType.simpleString()
        asking_rows = queries.withColumn("turn", turn(3)).select("turn", "key", "vector")
        asking_rows = asking_rows.mapInArrow(send, f"turn int, key long, vector {kind}, block int, leaves array<int>")
        dealt = self.placed().withColumn("part", F.xxhash64(F.lit(4), "key").bitwiseAND(F.lit(0x7FFFFFFF)))
        dealt = dealt.mapInArrow(deal, f"key long, vector {kind}, leaf int, block int")
        turned = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))) if turns > 1 else F.lit(0)
        dealt = dealt.withColumn("turn", turned)

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            keys = left["key"].to_numpy()
            own = matrix(left["vector"], width)[1]
            leaves = [np.array(some) for some in left["leaves"].to_pylist()]
            # Queries with the same vector visit the same leaves.
            same = _distinct(own)
            one = np.unique(same, return_index=True)[1]
            rows = matrix(right["vector"], width)[1]
            found = compare(
                own[one], [leaves[i] for i in one], right["key"].to_numpy(), rows, right["leaf"].to_numpy(), k + 1
            )
            query, key, score = found
            ends = np.searchsorted(query, np.arange(len(one) + 1))
            many = np.diff(ends)[same]
            at = np.repeat(ends[:-1][same], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            asker, key, score = np.repeat(np.arange(len(keys)), many), key[at], score[at]
            other = key != keys[asker]
            asker, key, score = asker[other], key[other], score[other]
            best = _best(asker, score, key, k)
            sizes = np.bincount(asker[best], minlength=len(keys))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            near = pa.StructArray.from_arrays([pa.array(-score[best]), pa.array(key[best])], ["far", "key"])
            return pa.table({"query": pa.array(keys), "near": pa.ListArray.from_arrays(offsets, near)})

        met = asking_rows.groupBy("block", "turn").cogroup(dealt.groupBy("block", "turn"))
        met = met.applyInArrow(meet, "query long, near array<struct<far: double, key: long>>")
        merged = met.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        ranked = merged.select("query", F.posexplode("near").alias("place", "near"))
        return ranked.select(
            "query",
            (F.col("place") + 1).alias("rank"),
            F.col("near.key").alias("key"),
            (-F.col("near.far")).alias("score"),
        )


__all__ = ["Index", "Tree", "compare", "nearest"]
