"""Exact top-k search by inner product over a vector-approximation file.

Vectors are scaled to integers. The file holds, for each block of vectors, their quantised
cells (one byte per component, on the block's own grid); the exact vectors are a table beside
it. A search scans the cells, which bound each score from below and above. Over all blocks the
k-th highest lower bound of a query rules out every vector whose upper bound is less. Of the
others exact vectors are fetched in order of their bounds: first the k with the highest upper
bounds; then those whose upper bound reaches the k-th exact score so far, after which no unread
vector can be among the k best. No exact vector is exchanged that the bounds rule out.

Bounds are widened by what rounding can do to the sum of their terms, and scores are exact: in
double or 64-bit arithmetic where the sum of the absolute products allows it, else in Python's
integers. A score of the result that is no 64-bit integer is an error.

Ties go to the smaller id. A query with fewer than k candidates gets them all; the query's own
row is no candidate. Null ids, and vectors that are null, empty, or hold null or non-finite
components, take no part; nor do vectors of another length than the commonest. Of a repeated id
every row counts, as a query and as a candidate of the others. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch
from joblattice.llm.vector_blocks import HITS, matrices, met, nearest, next_block, usable_vectors

BLOCKS = "block long, rows binary, low binary, step binary, cells binary"
QUERY_BLOCKS = "query_block long, query_rows binary, queries binary"
BOUNDS = "query_row long, row long, lower double, upper double"
PAIRS = 4096  # scored at a time
LEAST = -(2**63)  # stands for all scores below it, too
BEYOND = "a score is beyond a long: "


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="raise"):
        return np.floor(scale * vectors)


def write_cells(vectors: DataFrame, length: int, scale: int, block_rows: int, cells: int) -> DataFrame:
    def run(batches):
        state: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                rows, _, found = matrices(batch.slice(at, block_rows), length)
                exact = scaled(found, scale)
                low = exact.min(axis=0)
                step = np.maximum(np.ceil((exact.max(axis=0) - low + 1) / cells), 1.0)
                # of very large components the quotient may be rounded up to the number of cells
                cell = np.minimum((exact - low) // step, cells - 1).astype(np.uint8)
                values = [next_block(state), rows.astype("<i8").tobytes(), low.tobytes(), step.tobytes(), cell.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "rows", "low", "step", "cells"])

    return vectors.mapInArrow(run, BLOCKS)


def query_blocks(vectors: DataFrame, length: int, scale: int, block_rows: int) -> DataFrame:
    def run(batches):
        state: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                rows, _, found = matrices(batch.slice(at, block_rows), length)
                values = [next_block(state), rows.astype("<i8").tobytes(), scaled(found, scale).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["query_block", "query_rows", "queries"])

    return vectors.mapInArrow(run, QUERY_BLOCKS)


def scan_block(query_rows, queries, rows, low, step, cells, k: int):
    """Yields (query rows, rows, lower, upper) of the vectors of a block that can be among its k best."""
    bottom = low + step * cells
    top = bottom + step
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        upper, lower = plus @ top.T + minus @ bottom.T, plus @ bottom.T + minus @ top.T
        terms = np.abs(queries) @ np.maximum(np.abs(bottom), np.abs(top)).T
        slack = terms * (8 * (queries.shape[1] + 4) * np.finfo(float).eps)
        upper, lower = np.nan_to_num(upper + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(
            lower - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    own = query_rows[:, None] == rows[None, :]
    for i, query_row in enumerate(query_rows):
        others = np.flatnonzero(~own[i])
        if not len(others):
            continue
        below = lower[i][others]
        sure = np.partition(below, -k)[-k] if len(others) > k else -np.inf
        left = others[upper[i][others] >= sure]
        yield np.full(len(left), query_row), rows[left], lower[i][left], upper[i][left]


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Inner products of integers row by row."""
    with np.errstate(over="ignore"):
        largest = float((np.abs(queries) * np.abs(vectors)).sum(axis=1).max(initial=0.0))
    if largest < 2.0**53:
        return (queries * vectors).sum(axis=1).astype(np.int64).tolist()
    if largest < 2.0**62:
        return (queries.astype(np.int64) * vectors.astype(np.int64)).sum(axis=1).tolist()
    return [sum(int(a) * int(b) for a, b in zip(q, v)) for q, v in zip(queries.tolist(), vectors.tolist())]


def scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, length: int, scale: int) -> DataFrame:
    """(query_row, query_id, vec_id, score) of (query_row, row), with the exact vectors of these rows."""
    asked = queries.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("vector").alias("query"))
    read = vectors.select("row", F.col("id").alias("vec_id"), "vector")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                sides = [scaled(part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, length), scale) for c in ("query", "vector")]
                found = exact_scores(*sides)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in HITS[:3]), pa.array([float(s) for s in found], pa.float64()), pa.array([str(s) for s in found])],
                    names=[*HITS[:3], "near", "score"])

    joined = pairs.select("query_row", "row").join(read, "row").join(asked, "query_row")
    found = joined.select(*HITS[:3], "query", "vector").mapInArrow(
        run, "query_row long, query_id long, vec_id long, near double, score string")
    # above a long it is among the best for certain; below, only if it is left at the end
    above = F.raise_error(F.concat(F.lit(BEYOND), "score")).cast("long")
    whole = F.col("score").try_cast("long")
    return found.select(*HITS[:3], F.when(whole.isNotNull(), whole).when(F.col("near") < 0, F.lit(LEAST)).otherwise(above).alias("score"))


def search(
    rows: DataFrame, is_query: Column, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = 4096, query_rows: int = 256, cells: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``is_query`` (a condition on ``id``)."""
    scratch = Scratch(rows.sparkSession)
    found, length = usable_vectors(rows, id_col, vector_col)
    vectors = scratch.table("vectors", found)
    queries = vectors.filter(is_query)
    file = scratch.table("cells", write_cells(vectors, length, scale, block_rows, cells))
    asked = scratch.table("queries", query_blocks(queries, length, scale, query_rows))

    def run(batches):
        for batch in batches:
            for row in batch.select(["query_rows", "queries", "rows", "low", "step", "cells"]).to_pylist():
                own, asking = np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["query_rows"], "<i8")
                met_ = scan_block(
                    asking, np.frombuffer(row["queries"]).reshape(len(asking), length), own, np.frombuffer(row["low"]),
                    np.frombuffer(row["step"]), np.frombuffer(row["cells"], np.uint8).reshape(len(own), length), k)
                for columns in met_:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "row", "lower", "upper"])

    bounds = scratch.table("bounds", met(asked, file).mapInArrow(run, BOUNDS))
    falling = Window.partitionBy("query_row").orderBy(F.desc("lower"))
    sure = bounds.withColumn("n", F.row_number().over(falling)).filter(F.col("n") <= k).groupBy("query_row").agg(
        F.when(F.count(F.lit(1)) == k, F.min("lower")).otherwise(float("-inf")).alias("sure"))
    left = scratch.table("left", bounds.join(sure, "query_row").filter(F.col("upper") >= F.col("sure")).select("query_row", "row", "upper"))
    order = Window.partitionBy("query_row").orderBy(F.desc("upper"), "row")
    first = scratch.table("first", left.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query_row", "row"))
    best = scratch.table("best", scored(first, queries, vectors, length, scale))
    reached = best.groupBy("query_row").agg(F.min("score").alias("kth"))
    rest = left.join(first, ["query_row", "row"], "left_anti").join(reached, "query_row").filter(
        F.col("upper") >= F.col("kth").cast("double") - F.abs(F.col("kth").cast("double")) * 1e-15)
    found = nearest(best.unionByName(scored(rest, queries, vectors, length, scale)), k)
    beyond = F.raise_error(F.concat(F.lit(BEYOND), F.col("score").cast("string"))).cast("long")
    return found.withColumn("score", F.when(F.col("score") == LEAST, beyond).otherwise(F.col("score")))
