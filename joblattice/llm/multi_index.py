"""Approximate nearest neighbours by inner product over an inverted multi-index.

The two halves of the vectors are quantised apart, each by its own k-means centroids, so a pair
of centroids is a cell. A query visits cells by falling sum of its halves' inner products with
the two centroids, found with a heap over the two sorted lists, until the visited cells hold
``share`` of all vectors and k of them at least; the vectors of these cells are reranked by the
exact inner product in double precision.

The index holds every vector. The centroids are fitted on ``sample_rows`` vectors at most, those
with the least hash of their id. ``share`` trades time for recall; it is a share and not a
number, so recall keeps its level as the table grows.

Ties go to the smaller id; the query's own row is no candidate. Null ids, and vectors that are
null, empty, zero, or hold null or non-finite components, take no part; nor do vectors of
another length than the commonest. Of a repeated id every row counts, as a query and as a
candidate of the others. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch
from joblattice.llm.vector_blocks import hit_batch, matrices, met, nearest, next_block, usable_vectors

BLOCKS = "block long, cells binary, rows binary, ids binary, vectors binary"
QUERY_BLOCKS = "query_block long, query_rows binary, query_ids binary, queries binary, visits binary"
SPLITS = 64  # parts of a cell: even one that holds a third of all vectors is spread


def nearest_centroid(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(axis=1) - 2 * points @ centroids.T, axis=1)


def k_means(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k centroids; distinct points are the first ones."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    distinct = np.unique(points, axis=0)
    draw = np.random.default_rng(7)
    centroids = distinct[np.sort(draw.permutation(len(distinct))[:k])].copy()
    for _ in range(rounds):
        owner = nearest_centroid(points, centroids)
        counts = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    return centroids


def fit_centroids(vectors: DataFrame, length: int, k: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves, from a bounded sample in one task."""
    sample = vectors.orderBy(F.xxhash64("id"), "id", "vector").limit(sample_rows)
    half = length // 2

    def run(batches):
        found = [matrices(batch, length) for batch in batches]
        ids = np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64)
        points = np.concatenate([v for *_, v in found])[np.argsort(ids, kind="stable")] if found else np.zeros((0, length))
        halves = [k_means(p, k).astype("<f8").tobytes() for p in (points[:, :half], points[:, half:])]
        yield pa.RecordBatch.from_arrays([pa.array([h]) for h in halves], names=["a", "b"])

    row = sample.repartition(1).mapInArrow(run, "a binary, b binary").first()
    widths = (half, length - half)
    if row is None:
        return tuple(np.zeros((1, w)) for w in widths)
    return tuple(np.frombuffer(row[c]).reshape(-1, w) if w else np.zeros((1, 0)) for c, w in zip("ab", widths))


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by falling sum of ``first[i] + second[j]``, until they hold ``enough`` vectors."""
    order1, order2 = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    first, second, sizes, width = first.tolist(), second.tolist(), counts.tolist(), len(second)
    heap, out, held = [(-first[order1[0]] - second[order2[0]], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = order1[i] * width + order2[j]
        out.append(cell)
        held += sizes[cell]
        if j + 1 < len(order2):
            heapq.heappush(heap, (-first[order1[i]] - second[order2[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(order1):
            heapq.heappush(heap, (-first[order1[i + 1]] - second[order2[0]], i + 1, 0))
    return out


def rerank(query_rows, query_ids, queries, visits, cells, rows, ids, vectors, k: int):
    """Yields the k best of a block for each query, among the cells that the query visits."""
    bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    scores = np.full((len(query_ids), len(ids)), -np.inf)
    for start, end in zip(bounds[:-1], bounds[1:]):
        asking = np.flatnonzero(visits[:, cells[start]])
        if len(asking):
            scores[asking, start:end] = queries[asking] @ vectors[start:end].T
    scores[query_rows[:, None] == rows[None, :]] = -np.inf
    for i, query_id in enumerate(query_ids):
        row = scores[i]
        found = np.flatnonzero(row > -np.inf)
        if len(found) > k:  # with those that rounding may have put behind the k-th
            kth = np.partition(row[found], -k)[-k]
            found = found[row[found] >= kth - 1e-9 * max(1.0, abs(kth))]
        if len(found):
            exact = (vectors[found] * queries[i]).sum(axis=1)  # in the same order for every row
            best = np.lexsort((ids[found], -exact))[:k]
            yield np.full(len(best), query_rows[i]), np.full(len(best), query_id), ids[found[best]], exact[best]


def search(
    rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    centroids: int = 32, share: float = 0.65, sample_rows: int = 20_000, block_rows: int = 4096, query_rows: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``is_query`` (a condition on ``id``)."""
    scratch = Scratch(rows.sparkSession)
    vectors, length = usable_vectors(rows, id_col, vector_col)
    vectors = scratch.table("vectors", vectors.filter(F.exists("vector", lambda x: x != 0)))
    half = length // 2
    first, second = fit_centroids(vectors, length, centroids, sample_rows)
    width = len(second)

    def assign(batches):
        for batch in batches:
            *_, found = matrices(batch, length)
            cell = nearest_centroid(found[:, :half], first) * width + nearest_centroid(found[:, half:], second)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32))], names=["row", "id", "vector", "cell"])

    index = scratch.table("index", vectors.mapInArrow(assign, "row long, id long, vector array<double>, cell int"))
    counts = np.zeros(len(first) * width, np.int64)  # one number per pair of centroids
    for row in index.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    enough = max(int(np.ceil(share * counts.sum())), k + 1)

    def lists(batches):
        state: dict = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for at in range(0, batch.num_rows, block_rows):
                rows, ids, found = matrices(batch.slice(at, block_rows), length)
                values = [next_block(state), cells[at : at + block_rows].astype("<i4").tobytes(), rows.astype("<i8").tobytes(),
                          ids.astype("<i8").tobytes(), found.astype("<f8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "cells", "rows", "ids", "vectors"])

    def plan(batches):
        state: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, query_rows):
                rows, ids, found = matrices(batch.slice(at, query_rows), length)
                visits = np.zeros((len(ids), len(counts)), bool)
                near1, near2 = found[:, :half] @ first.T, found[:, half:] @ second.T
                for i in range(len(ids)):
                    visits[i, visited(near1[i], near2[i], counts, enough)] = True
                values = [next_block(state), rows.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), found.astype("<f8").tobytes(),
                          np.packbits(visits).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v]) for v in values], names=["query_block", "query_rows", "query_ids", "queries", "visits"])

    parts = max(1, -(-int(counts.sum()) // (4 * block_rows)))
    # a cell's vectors come together, in full blocks; a cell with very many is spread over parts
    split = F.pmod(F.xxhash64("row"), F.lit(SPLITS))
    part = F.pmod(F.xxhash64("cell", split), F.lit(parts)).cast("int")
    dealt = index.withColumn("part", part).repartitionById(parts, F.col("part")).sortWithinPartitions("cell", "row")
    file = scratch.table("lists", dealt.select("row", "id", "vector", "cell").mapInArrow(lists, BLOCKS))
    asked = scratch.table("queries", index.filter(is_query).select("row", "id", "vector").mapInArrow(plan, QUERY_BLOCKS))
    scratch.drop("vectors", "index")

    def run(batches):
        for batch in batches:
            for row in batch.select(["query_rows", "query_ids", "queries", "visits", "cells", "rows", "ids", "vectors"]).to_pylist():
                query_rows_, query_ids, rows_, ids = (np.frombuffer(row[c], "<i8") for c in ("query_rows", "query_ids", "rows", "ids"))
                visits = np.unpackbits(np.frombuffer(row["visits"], np.uint8), count=len(query_ids) * len(counts))
                found = rerank(
                    query_rows_, query_ids, np.frombuffer(row["queries"]).reshape(len(query_ids), length),
                    visits.reshape(len(query_ids), len(counts)).astype(bool), np.frombuffer(row["cells"], "<i4"), rows_, ids,
                    np.frombuffer(row["vectors"]).reshape(len(ids), length), k)
                yield hit_batch(list(found), pa.float64())

    return nearest(met(asked, file).mapInArrow(run, "query_row long, query_id long, vec_id long, score double"), k)
