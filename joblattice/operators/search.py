"""Nearest listings, for one question or many."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


TOP_K = 15
PARTS_OF_RANK = 16
# Distances this close count as equal, so that equal vectors tie and the id decides.
DISTANCE_DIGITS = 12
_CHUNK = 256


def has_embedding(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("embedding").isNotNull())


class _Nearest:
    """The k nearest listings seen so far, for a block of question vectors.

    A pair without a cosine (a vector of length zero) ranks behind all others.
    """

    def __init__(self, questions: np.ndarray, k: int):
        self.questions, self.usable = _unit_rows(questions)
        self.k = k
        self.distance = [np.empty(0)] * len(questions)
        self.ids: list[np.ndarray] = [np.empty(0, dtype=object)] * len(questions)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        units, usable = _unit_rows(vectors)
        for start in range(0, len(self.questions), _CHUNK):
            block = slice(start, start + _CHUNK)
            distances = np.round(1.0 - self.questions[block] @ units.T, DISTANCE_DIGITS)
            distances[:, ~usable] = np.inf
            distances[~self.usable[block]] = np.inf
            for row, found in enumerate(distances, start):
                self._merge(row, ids, found)

    def _merge(self, row: int, ids: np.ndarray, found: np.ndarray) -> None:
        if len(found) > self.k:
            bound = np.partition(found, self.k - 1)[self.k - 1]
            close = found <= bound
            ids, found = ids[close], found[close]
        ids = np.concatenate([self.ids[row], ids])
        found = np.concatenate([self.distance[row], found])
        best = np.lexsort((ids, found))[: self.k]
        self.ids[row], self.distance[row] = ids[best], found[best]


def _unit_rows(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.linalg.norm(vectors, axis=1)
    usable = lengths > 0
    return vectors / np.where(usable, lengths, 1.0)[:, None], usable


def _vectors(column: pa.ListArray, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype("float64").reshape(len(column), dims)


def _nearest_in_one_pass(
    listings: DataFrame, keys: Sequence, vectors: np.ndarray, k: int, question_type
) -> DataFrame:
    dims = vectors.shape[1]
    shared = listings.sparkSession.sparkContext.broadcast((list(keys), vectors))
    id_type = listings.schema["id"].dataType.simpleString()
    key_type = to_arrow_type(question_type)
    schema = f"question_id {question_type.simpleString()}, id {id_type}, distance double"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_ids, questions = shared.value
        nearest = _Nearest(questions, k)
        arrow_id = None
        for batch in batches:
            arrow_id = batch.column(0).type
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(object)
            nearest.add(ids, _vectors(batch.column(1), dims))
        if arrow_id is None:
            return
        for question, ids, distances in zip(question_ids, nearest.ids, nearest.distance):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([question] * len(ids), type=key_type),
                    pa.array(ids.tolist(), type=arrow_id),
                    pa.array(distances, mask=np.isinf(distances)),
                ],
                names=["question_id", "id", "distance"],
            )

    wrong = F.concat(F.lit(f"the question has {dims} dimensions, a listing has "), F.size("embedding"))
    fitting = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(wrong))
    return has_embedding(listings).select("id", fitting.alias("embedding")).mapInArrow(search, schema)


def _packed(rows: DataFrame, key: str, names: tuple[str, str, str], size: int) -> DataFrame:
    """Rows (key, embedding) as blocks: an array of keys, the vectors as bytes, their width."""
    key_type = rows.schema[key].dataType
    arrow_type = pa.list_(to_arrow_type(key_type))
    keys, vectors, width = names

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dims in np.unique(widths).tolist():
                alike = batch.filter(pa.array(widths == dims))
                for start in range(0, alike.num_rows, size):
                    part = alike.slice(start, size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part.column(0).to_pylist()], type=arrow_type),
                            pa.array([_vectors(part.column(1), dims).tobytes()]),
                            pa.array([dims], type=pa.int32()),
                        ],
                        names=names,
                    )

    schema = f"{keys} array<{key_type.simpleString()}>, {vectors} binary, {width} int"
    return has_embedding(rows.select(key, "embedding")).mapInArrow(pack, schema)


def rank_per_question(
    questions: DataFrame, listings: DataFrame, k: int = TOP_K, groups: int | None = None,
    listing_rows: int = 4096, question_rows: int = 256,
) -> DataFrame:
    """The k nearest listings of every question: question_id, id, distance, rank.

    Listings and questions are packed into blocks. The blocks of listings are dealt to
    ``groups`` groups, and every block of questions goes to each group, where a task multiplies
    block with block and keeps k rows per question. There are about as many groups as blocks by
    default, so a task's share doesn't grow with the listings, which are counted for that. The
    kept rows are ranked in ``PARTS_OF_RANK`` parts of a question and then over these. Nothing
    passes through the driver.
    """
    groups = groups or max(1, -(-listings.count() // listing_rows))
    question_type, id_type = questions.schema["question_id"].dataType, listings.schema["id"].dataType
    blocks = _packed(listings, "id", ("ids", "vectors", "width"), listing_rows)
    blocks = blocks.withColumn("group", F.pmod(F.xxhash64("vectors"), F.lit(groups)).cast("int"))
    asked = _packed(questions, "question_id", ("question_ids", "questions", "question_width"), question_rows)
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    arrow_types = to_arrow_type(question_type), to_arrow_type(id_type)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dims, width = row["question_width"], row["width"]
                if dims != width:
                    raise ValueError(f"a question has {dims} dimensions, a listing has {width}")
                nearest = _Nearest(np.frombuffer(row["questions"]).reshape(-1, dims), k)
                ids = np.empty(len(row["ids"]), dtype=object)
                ids[:] = row["ids"]
                nearest.add(ids, np.frombuffer(row["vectors"]).reshape(-1, dims))
                counts = [len(found) for found in nearest.ids]
                distances = np.concatenate(nearest.distance)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([q for q, n in zip(row["question_ids"], counts) for _ in range(n)], type=arrow_types[0]),
                        pa.array(np.concatenate(nearest.ids).tolist(), type=arrow_types[1]),
                        pa.array(distances, mask=np.isinf(distances)),
                    ],
                    names=["question_id", "id", "distance"],
                )

    met = asked.join(blocks, "group").select(
        "question_ids", "questions", "question_width", "ids", "vectors", "width")
    found = met.mapInArrow(
        search, f"question_id {question_type.simpleString()}, id {id_type.simpleString()}, distance double")
    order = [F.asc_nulls_last("distance"), F.col("id")]
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS_OF_RANK))
    within = Window.partitionBy("question_id", part).orderBy(*order)
    parts = found.withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= k).drop("_rank")
    window = Window.partitionBy("question_id").orderBy(*order)
    return parts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def similarity_topk(listings: DataFrame, vector: Sequence[float], k: int = TOP_K) -> DataFrame:
    """The k nearest listings of one vector: id, distance."""
    question = np.array([list(vector)], "float64")
    nearest = _nearest_in_one_pass(listings, [0], question, k, T.IntegerType())
    return nearest.select("id", "distance").orderBy(F.asc_nulls_last("distance"), "id").limit(k)
