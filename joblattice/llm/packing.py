"""Documents packed into sequences of bounded length by bounded-space best fit.

Pieces arrive one after the other. A piece goes to the open bin that it fills best, found by
one look at a bitset keyed by free space; a bin that becomes full closes. When a new bin is
needed and ``open_bins`` are open, the fullest closes first. Only the open bins are held.

Spark deals the pieces to packers by a hash and sorts each packer's pieces by falling
length, so that a repeated task packs alike. Packers don't share bins, which costs at most a
few part-full bins each; there are about ``rows_per_packer`` pieces to one.

Null and empty texts are one piece, the end id alone. A document longer than a sequence is
cut; its first piece takes the remainder, the others are full. Ties of length go by id, then
by piece; repeated rows are packed as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch, text_or_empty, uncollected
from joblattice.llm.tokens import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """The open bins by free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.opened = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and the piece's offset in it."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.open_bins:  # the fullest has the least free space
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, number = self.capacity, self.opened
            self.opened += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first may be shorter than the others."""
    first = length % capacity or min(length, capacity)
    yield 0, first
    for start in range(first, length, capacity):
        yield start, capacity


def token_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text",
    keeps_space: bool = True, with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, with their ids where asked for."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        own = encoder(vocabulary, keeps_space)
        with uncollected():
            yield from cut_pieces(own, batches)

    def cut_pieces(own, batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), own.ids(part.column(1).to_pylist())):
                    ids += end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own_ids = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, piece, start, length, zlib.crc32(own_ids), own_ids if with_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def best_fit(pieces: DataFrame, capacity: int, open_bins: int = 4096, packers: int = 1) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32)."""

    def run(batches):
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + n for n, _ in placed], pa.int64()),
                 pa.array([at for _, at in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # every column takes part in the hash: no document id, however common, fills one packer
    dealt = pieces.select(*columns).repartition(packers, F.xxhash64(*columns))
    ordered = dealt.sortWithinPartitions(F.desc("length"), *columns)
    return ordered.mapInArrow(run, PLACED)


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, open_bins: int = 4096,
    rows_per_packer: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Cut and pack all documents; one row per piece.

    The pieces are staged without their ids (a narrow table), for their number sets the number
    of packers and each document is encoded once.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.table("pieces", token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col).drop("ids"))
    return best_fit(pieces, capacity, open_bins, max(1, -(-pieces.count() // rows_per_packer)))
