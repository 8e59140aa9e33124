"""Vectors packed into blocks, and every block of queries met with every block of vectors.

A vector takes part if its id and all its components are there, the components are finite, and
its length is the commonest one of the table (of equally common lengths the least). Every row
counts, so rows are told apart by a number of their own and not by their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector_col: str) -> Column:
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~bad


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(row, id, vector) of the rows that take part, and their length (0: none).

    ``row`` is a row's place in the table; the result has to be written before it is used twice.
    """
    found = rows.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    length = found.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = length["n"] if length else 0
    return found.filter(F.size("vector") == length).select(F.monotonically_increasing_id().alias("row"), "id", "vector"), length


def matrices(batch, length: int):
    """The row numbers, the ids and the vectors of an Arrow batch (row, id, vector)."""
    rows, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id"))
    return rows, ids, batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), length)


def next_block(state: dict) -> int:
    """Block numbers, unique over all tasks."""
    state["n"] = state.get("n", -1) + 1
    return (TaskContext.get().partitionId() << 32) + state["n"]


def met(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each query block beside each vector block, joined by groups of vector blocks.

    The query set is a stated one. It goes to every group of vector blocks, and there are about
    as many groups as blocks, so that no task gets more than a few of either. Spark takes the
    repeated query blocks to be as small as the table they are repeated from; the hint keeps them
    from being broadcast, which would send them through the driver.
    """
    groups = max(1, blocks.count())
    dealt = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    spread = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return spread.hint("merge").join(dealt, "group")


def nearest(hits: DataFrame, k: int) -> DataFrame:
    """The k best of (query_row, query_id, vec_id, score); ties go to the smaller vec_id.

    Each task keeps its own k best of a query before rows are exchanged.
    """
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


HITS = ["query_row", "query_id", "vec_id", "score"]


def hit_batch(found: list[tuple[np.ndarray, ...]], score_type) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(HITS)
    kinds = [pa.int64(), pa.int64(), pa.int64(), score_type]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=HITS)
