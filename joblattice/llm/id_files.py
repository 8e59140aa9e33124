"""Token ids in binary files of compressed bit planes.

File: the chunks, then a footer, then the footer's length (8 bytes) and a mark (8 bytes).
A chunk holds ``CHUNK`` ids, the last one fewer. Its ids are transposed into bit planes,
each compressed on its own; planes above the highest bit in use are absent. The footer is a
zstandard-compressed table: for each chunk its offset, its number of ids and its planes'
lengths, and for each document its id and its number of ids.

Files are in ascending order of document id: every file holds a range of ids, and its rows
are sorted. Null ids come first. Rows with the same id are in the order of their text's
hash; equal rows are equal in the file too, so their order doesn't matter. Null and empty
texts have the end id alone. Extra columns are ignored. A task writes its file under the
name of its attempt and renames it, so a repeated task replaces it by the same bytes.
"""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch, text_or_empty, uncollected
from joblattice.llm.tokens import encoder, slices

CHUNK = 1 << 16
MARK = b"IDPLANE1"
MANIFEST = "file int, path string, docs long, ids long"
DOCS = "file int, place long, doc_id long, start long, n_tokens long, ids binary"


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The bit planes of a block, lowest bit first."""
    top = int(ids.max(initial=0)).bit_length()
    return [np.packbits((ids >> np.uint32(bit)) & np.uint32(1) != 0).tobytes() for bit in range(top)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    ids = np.zeros(count, np.uint32)
    for bit, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count).astype(np.uint32) << np.uint32(bit)
    return ids


class FileWriter:
    """Takes the ids of one document after the other; at most one chunk is held back."""

    def __init__(self, sink, chunk: int = CHUNK, level: int = 1):
        self.sink, self.chunk, self.zstd = sink, chunk, zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.waiting = self.written = 0
        self.index: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[int, int, int]] = []  # null mark, id, number of ids

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((int(doc_id is None), doc_id or 0, len(ids) // 4))
        self.held.append(np.frombuffer(ids, "<u4"))
        self.waiting += len(ids) // 4
        if self.waiting >= self.chunk:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        full = len(ids) if all_of_it else len(ids) // self.chunk * self.chunk
        for at in range(0, full, self.chunk):
            block = ids[at : min(at + self.chunk, full)]
            planes = [self.zstd.compress(p) for p in to_planes(block)]
            self.index.append((self.written, len(block), [len(p) for p in planes]))
            for plane in planes:
                self.sink.write(plane)
                self.written += len(plane)
        self.held, self.waiting = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        footer = io.BytesIO()
        footer.write(struct.pack("<qq", len(self.index), len(self.docs)))
        for offset, count, lengths in self.index:
            footer.write(struct.pack(f"<qqq{len(lengths)}q", offset, count, len(lengths), *lengths))
        footer.write(np.asarray(self.docs, "<i8").tobytes())
        packed = self.zstd.compress(footer.getvalue())
        self.sink.write(packed + struct.pack("<q", len(packed)) + MARK)


def read_file(content: bytes):
    """Yields (doc_id, ids) of a file in order; chunks are unpacked as they are needed."""
    if content[-8:] != MARK:
        raise ValueError("not a file of token ids")
    size = struct.unpack("<q", content[-16:-8])[0]
    zstd = zstandard.ZstdDecompressor()
    footer = zstd.decompress(content[-16 - size : -16])
    chunks, docs = struct.unpack_from("<qq", footer)
    at, index = 16, []
    for _ in range(chunks):
        offset, count, planes = struct.unpack_from("<qqq", footer, at)
        index.append((offset, count, struct.unpack_from(f"<{planes}q", footer, at + 24)))
        at += 24 + 8 * planes
    table = np.frombuffer(footer, "<i8", docs * 3, at).reshape(docs, 3)
    buffer, following = np.zeros(0, np.uint32), iter(index)
    for null, doc_id, need in table.tolist():
        parts = [buffer]
        have = len(buffer)
        while have < need:
            offset, count, lengths = next(following)
            planes = []
            for length in lengths:
                planes.append(zstd.decompress(content[offset : offset + length]))
                offset += length
            parts.append(from_planes(planes, count))
            have += count
        buffer = np.concatenate(parts) if len(parts) > 1 else buffer
        yield (None if null else doc_id), buffer[:need]
        buffer = buffer[need:]


def write_ids(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
    keeps_space: bool = False,
) -> DataFrame:
    """Encode all texts and write them below ``folder``; returns (file, path, docs, ids) per file.

    ``files`` ranges of ids are cut (the session's shuffle partitions by default), each
    becomes a file unless it is empty.
    """
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = np.asarray([end_id], "<u4").tobytes()

    def write(batches):
        own = encoder(vocabulary, keeps_space)
        with uncollected():
            yield from written(own, batches)

    def written(own, batches):
        task = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        number, writer, total = task.partitionId(), None, 0
        final = f"{base}/ids-{number:06d}.bin"
        draft = f"{base}/.ids-{number:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        for batch in batches:
            for part in slices(batch):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(draft)
                    writer = FileWriter(sink)
                for doc_id, ids in zip(part.column(0).to_pylist(), own.ids(part.column(1).to_pylist())):
                    writer.add(doc_id, ids + end)
                    total += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            sink.close()
            store.move(draft, final)
            yield pa.RecordBatch.from_pylist(
                [{"file": number, "path": final, "docs": len(writer.docs), "ids": total}],
                schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]),
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "tie")
    return ordered.select("doc_id", "text").mapInArrow(write, MANIFEST)


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (file, place, doc_id, start, n_tokens, ids) of all documents in the files.

    ``place`` is the document's place in its file, ``start`` the ids of all documents before
    it. The sums run over the manifest, which has one row per file.
    """

    def read(batches):
        for batch in batches:
            for number, content, base in zip(*(c.to_pylist() for c in batch.columns)):
                start, rows, held = base, [], 0
                for place, (doc_id, ids) in enumerate(read_file(content)):
                    rows.append((number, place, doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    held += len(ids)
                    if held > 1_000_000:
                        yield _doc_rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _doc_rows(rows)

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    number = F.regexp_extract("path", r"ids-(\d+)\.bin$", 1).cast("int")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder)
    return files.select(number.alias("file"), "content").join(starts, "file").select("file", "content", "base").mapInArrow(
        read, DOCS)


def _doc_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["file", "place", "doc_id", "start", "n_tokens", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, **how) -> DataFrame:
    """Write the files, then read them back; one row per document, in no order."""
    scratch = Scratch(docs.sparkSession)
    folder = folder or scratch.path("ids")
    manifest = scratch.table("manifest", write_ids(docs, folder, vocabulary, end_id, **how))
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], DOCS)
    return read_ids(docs.sparkSession, folder, manifest)


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


