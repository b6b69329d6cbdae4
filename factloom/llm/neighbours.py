"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample (SAMPLE_ROWS distinct vectors, those
with the smallest hash of their id): a node draws two of its vectors, projects
on the line through them and splits at the median, down to LEAF_ROWS vectors a
leaf. Every vector of the table is then put into its leaf of every tree. A
query walks all trees through one shared priority queue, nearest margin first,
until it has seen its number of leaves; the vectors of those leaves are then
measured exactly, in the leaf's own task. A task merges what its leaves found
for a query before it is shuffled, so a query sends k rows a task, not k a leaf.

Equal vectors are indexed by their k + 1 smallest ids alone (no list can use
more), and equal queries are searched once, so a vector that fills a third of
the table costs no more than another. Leaves are counted first: one of more
than PIECE_ROWS vectors is dealt to as many tasks as its size asks for, each of
which sees all its queries. A task streams the queries past its vectors in
blocks, and sends what it has found in parts of MERGED_ROWS.

Defined results: vectors that are null, empty, all zero, or hold a null or
non-finite component, and rows with a null id, take no part; vectors of another
length than the query's are an error; components that are floats stay floats
in the shuffle, all others are doubles, and all distances are in doubles; equal distances go to the smaller id; a
query with fewer candidates than k gets all; repeated rows count once; rows
that share an id with different vectors are one candidate at its nearest and,
as queries, are searched each; other columns are not looked at; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import join_hot, schema_of

SAMPLE_ROWS, LEAF_ROWS, TREES = 32_768, 128, 8
#: The share of all leaves that a query visits, and how many at least.
VISITED, LEAST_VISITED = 0.13, 64
#: Rows and queries measured at once, and results that a task holds before it merges them.
BLOCK_ROWS, BLOCK_QUERIES, MERGED_ROWS = 4096, 256, 262_144
#: Vectors of a leaf that one task holds.
PIECE_ROWS = 65_536


@dataclass
class Forest:
    """Complete binary trees; node i has the children 2 i + 1 and 2 i + 2."""

    depth: int
    normals: np.ndarray  # trees, nodes, dimensions
    cuts: np.ndarray  # trees, nodes

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > cuts[node])
            out[:, t] = node - self.inner
        return out

    def visit(self, q: np.ndarray, n: int) -> list[tuple[int, int]]:
        """The first n leaves (tree, leaf) of a query, by the largest margin on the way to each, over all trees."""
        margins = [(normals @ q - cuts).tolist() for normals, cuts in zip(self.normals, self.cuts, strict=True)]
        queue = [(0.0, t, 0) for t in range(len(margins))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < n:
            worst, t, node = heapq.heappop(queue)
            if node >= self.inner:
                found.append((t, node - self.inner))
                continue
            margin = margins[t][node]
            near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (worst, t, near))
            heapq.heappush(queue, (max(worst, abs(margin)), t, far))
        return found


def fit(sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 1) -> Forest:
    depth = max(0, (max(1, len(sample)) // leaf_rows).bit_length() - 1)
    inner, dims = (1 << depth) - 1, sample.shape[1] if sample.ndim == 2 else 0
    forest = Forest(depth, np.zeros((trees, inner, dims)), np.zeros((trees, inner)))
    for t in range(trees):
        rng, parts = np.random.default_rng((seed, t)), {0: np.arange(len(sample))}
        for node in range(inner):
            own = parts.pop(node)
            a, b = sample[rng.choice(own, 2, replace=False)] if len(own) > 1 else rng.normal(size=(2, dims))
            normal = a - b
            normal /= np.linalg.norm(normal) or 1.0
            along = sample[own] @ normal
            forest.normals[t, node], forest.cuts[t, node] = normal, np.median(along) if len(own) else 0.0
            parts[2 * node + 1], parts[2 * node + 2] = own[along <= forest.cuts[t, node]], own[along > forest.cuts[t, node]]
    return forest


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q the k nearest rows of x: index of the query, id, exact distance. Ties go to the smaller id; rows that share an id are one, at its nearest."""
    norms = (x * x).sum(axis=1)
    rough = norms - 2 * (q @ x.T)
    slack = 1e-9 * (1 + norms.max(initial=0.0) + (q * q).sum(axis=1))
    if len(x) > k and len(np.unique(ids)) == len(ids):
        bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
        of, near = np.nonzero(rough <= (bound + slack)[:, None])
    else:
        of, near = np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
    return best_of(of, ids[near], np.sqrt(((x[near] - q[of]) ** 2).sum(axis=1)), k)


def best_of(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each key, an id once."""
    order = np.lexsort((scores, ids, keys))
    keys, ids, scores = keys[order], ids[order], scores[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids, scores = keys[first], ids[first], scores[first]
    order = np.lexsort((ids, scores, keys))
    keys, ids, scores = keys[order], ids[order], scores[order]
    place = np.arange(len(keys)) - np.searchsorted(keys, keys)
    return keys[place < k], ids[place < k], scores[place < k]


_CELLS = ("cell", "kind", "id", "vector")
_FOUND = schema_of(key="long", vec_id="long", score="double")


def _rerank(k: int, stored: type, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, indexed vectors first: for each query the k nearest of the cells of a task, in several parts if they are many."""
    cell, ids, blocks, found, n_found = None, [], [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return best_of(*(np.concatenate(c) for c in zip(*found, strict=True)), k)

    def sent(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=_FOUND.names)

    for batch in batches:
        cells, kinds, keys = (batch.column(i).to_numpy() for i in range(3))
        raw = batch.column(3)
        edges = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)], strict=True):
            if a == b:
                continue
            if cells[a] != cell:
                cell, ids, blocks = cells[a], [], []
            if kinds[a] == 1 and not blocks:
                continue
            x = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), stored).reshape(b - a, -1)
            if kinds[a] == 0:
                ids.append(keys[a:b])
                blocks.append(x)
                continue
            if len(blocks) > 1:
                ids, blocks = [np.concatenate(ids)], [np.concatenate(blocks)]
            for start in range(0, len(ids[0]), BLOCK_ROWS):
                block, own = blocks[0][start : start + BLOCK_ROWS].astype(np.float64), ids[0][start : start + BLOCK_ROWS]
                for at in range(0, len(x), BLOCK_QUERIES):
                    of, near, scores = nearest_of(x[at : at + BLOCK_QUERIES].astype(np.float64), block, own, k)
                    found.append((keys[a:b][at + of], near, scores))
                    n_found += len(of)
                    if n_found > MERGED_ROWS:
                        best = merged()
                        if len(best[0]) > MERGED_ROWS // 2:
                            yield sent(best)
                            found, n_found = [], 0
                        else:
                            found, n_found = [best], len(best[0])
    if found:
        yield sent(merged())


def nearest(
    vectors: DataFrame,
    queries: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
    visited: float = VISITED,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest found for each query row, itself left out.

    queries: which rows of the table are queries (a condition on it); by default all.
    """
    asked = F.lit(True) if queries is None else queries
    component = vectors.schema[vector_col].dataType.elementType
    as_stored, stored = (component, np.float32) if isinstance(component, T.FloatType) else (T.DoubleType(), np.float64)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(T.ArrayType(as_stored)).alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable("vector"))
    alike = Window.partitionBy("vector").orderBy("id")
    indexed = rows.withColumn("__n", F.dense_rank().over(alike)).where(F.col("__n") <= k + 1).distinct()
    sample = indexed.where("__n = 1").select("id", "vector").orderBy(F.xxhash64("id"), "id", "vector").limit(sample_rows)
    drawn = sample.toPandas().vector.tolist()
    forest = fit(np.array(drawn, np.float64) if drawn else np.zeros((0, 0)), trees, leaf_rows)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)  # its size is bounded by the sample's
    n_leaves = max(LEAST_VISITED, round(visited * trees * (forest.inner + 1)))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many vectors of a task each leaf of each tree has."""
        forest = shared.value
        total = np.zeros((trees, forest.inner + 1), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                leaf = forest.leaves(_matrix(batch.column(0).slice(start, 4096)))
                np.add.at(total, (np.broadcast_to(np.arange(trees), leaf.shape), leaf), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["leaf", "n"])

    counted = indexed.select("vector").mapInArrow(size, schema_of(leaf="long", n="long")).groupBy("leaf").agg(F.sum("n").alias("n"))
    pieces = np.ones((trees, forest.inner + 1), np.int64)  # of each leaf: as many numbers as there are leaves
    for row in counted.where(F.col("n") > PIECE_ROWS).collect():
        pieces.ravel()[row.leaf] = -(-row.n // PIECE_ROWS)

    def place(kind: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree and vector, or for each piece of a leaf that a query visits."""
        forest, step = shared.value, 1024 if kind == 0 else max(1, 16_384 // (n_leaves * int(pieces.max())))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                if kind == 0:
                    leaf = forest.leaves(x)
                    row = np.repeat(np.arange(len(x)), trees)
                    piece = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
                    of_leaf = pieces[np.arange(trees)[None, :], leaf].ravel()
                    cell = (np.arange(trees) << 48 | leaf << 24).ravel() | piece.astype(np.int64)[row] % of_leaf
                else:
                    found = [[(t, i, p) for t, i in forest.visit(q, n_leaves) for p in range(pieces[t, i])] for q in x]
                    row = np.repeat(np.arange(len(x)), [len(f) for f in found])
                    cell = np.array([t << 48 | i << 24 | p for f in found for t, i, p in f], np.int64)
                packed = pa.array([v.tobytes() for v in x.astype(stored)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), kind, np.int32)), pa.array(ids[row]), packed.take(pa.array(row))], names=_CELLS)

    placed = schema_of(cell="long", kind="int", id="long", vector="binary")
    members = rows.where("asked").select("id", "vector").distinct()
    classes = members.groupBy("vector").agg(F.min("id").alias("key"))
    data = indexed.select("id", "vector").mapInArrow(lambda it: place(0, it), placed)
    probes = classes.select("key", "vector").mapInArrow(lambda it: place(1, it), placed)
    dealt = data.unionByName(probes).repartition("cell").sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(lambda it: _rerank(k + 1, stored, it), _FOUND)
    nearest_first = found.groupBy("key", "vec_id").agg(F.min("score").alias("score"))
    ranked = nearest_first.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    lists = ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("list"))
    named = join_hot(join_hot(members, classes, ["vector"]).select("id", "key"), lists, ["key"])
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return named.select(F.col("id").alias("query_id"), F.posexplode(others)).select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")
