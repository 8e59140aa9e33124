"""Benchmark decontamination by a prefix-filtered set join.

Texts are words: A-Z in lower case, cut at all other ASCII characters but digits and letters. An
item's windows are its runs of ``window`` words; an item of fewer words, but not none, is one
window. A window is the set of its shingles (runs of ``shingle`` words; a shorter window is one
shingle), and a document contains it only if it contains all of them. So of the shingles in order
of rarity over all documents a prefix of one is necessary: the rarest. Documents and windows meet
on that one; the shingle's place must leave room for the window before and behind it (positional
and length bounds), and the window's words are then compared with the document's.

Documents are read once. What a task needs of the benchmark for that is a bitmap of its shingles,
of 2**``filter_bits`` bits however large the benchmark is. A hit is a run of words all of whose
shingles are in the bitmap and which is as long as the shortest window at least; what the bitmap
lets through by chance finds no window and changes no result. Hits carry only the words around
them, and a hot passage is a plain join key that Spark splits.

Null texts have no words. A null item_id is one item, written as an empty string in the list of
items. Repeated rows of documents are documents of their own; repeated windows count once for each
item. Empty tables are handled; without a benchmark no document is hit. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch, held, text_or_empty
from joblattice.llm.quality import mixed

WINDOW, SHINGLE = 10, 5
FILTER_BITS = 24
SEGMENT = 2 << 20
NOTHING = hashlib.sha256(b"").hexdigest()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[0x80:] = True
CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE, STEP = 0xD6E8FEB86659FD93, np.uint64(0xA0761D6478BD642F)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, for the places of a segment."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._of(base, max(n, SEGMENT + 1)) for base in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _of(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of lower-case bytes; no word spans one of ``bounds``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = IN_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds - bounds[0]] = cut[0] = cut[-1] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.r_[inside[1:], False])) + 1
    up, down = held(Powers).upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * up[:-1], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts])


class Texts:
    """The words of some texts of an Arrow column."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        buffers = column.buffers()
        bounds = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]] if buffers[2] else np.zeros(0, np.uint8)
        self.bounds, self.data = bounds - bounds[0], LOWER[data]
        found, at = [], 0
        while at < len(self.data) or not found:
            to = min(at + SEGMENT, len(self.data))
            while to < len(self.data) and IN_WORD[self.data[to]]:  # a segment ends where no word is cut
                to += 1
            within = self.bounds[(self.bounds >= at) & (self.bounds <= to)]
            starts, ends, hashes = words_of(self.data[at:to], np.r_[at, within])
            found.append((starts + at, ends + at, hashes))
            at = to
        self.starts, self.ends, self.hashes = (np.concatenate(c) for c in zip(*found))
        self.first = np.searchsorted(self.starts, self.bounds)  # of each text, and the end

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the run of ``width`` words from each word on, whether its text has them all)."""
        n = len(self.hashes)
        value = np.zeros(n, np.uint64)
        for k in range(width):
            value = value * STEP
            value[: n - k] += self.hashes[k:] if k < n else 0
        last = np.repeat(self.first[1:], np.diff(self.first))
        return mixed(value), np.arange(n) + width <= last

    def words(self, start: int, end: int) -> list[str]:
        return [self.data[s:e].tobytes().decode() for s, e in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist())]


def text_parts(batch: pa.RecordBatch, size: int = SEGMENT):
    """(batch, its texts' words) in slices of at most ``size`` bytes of text, or of one row."""
    lengths = np.asarray(pc.binary_length(batch.column("text")).cast(pa.int64()))
    part = (np.cumsum(lengths) - lengths) // size
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(lengths)] if len(lengths) else [0]
    for start, end in zip(edges[:-1], edges[1:]):
        rows = batch.slice(start, end - start)
        yield rows, Texts(rows.column("text"))


def windows_of(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words, length, tokens) of each window of each item; words are joined by a space."""

    def run(batches):
        for batch in batches:
            for rows, texts in text_parts(batch):
                values = {w: texts.shingles(w)[0].view(np.int64) for w in range(1, shingle + 1)}
                found = []
                for item, first, end in zip(rows.column("item").to_pylist(), texts.first[:-1].tolist(), texts.first[1:].tolist()):
                    length = min(window, end - first)
                    width = min(shingle, length)
                    words = texts.words(first, end)
                    found += [(item, " ".join(words[i : i + length]), length, values[width][first + i : first + i + length - width + 1].tolist())
                              for i in range(end - first - length + 1) if length]
                columns = list(zip(*found)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()),
                     pa.array(columns[3], pa.list_(pa.int64()))], names=["item", "words", "length", "tokens"])

    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, "item string, words string, length int, tokens array<long>")


def shingle_filter(windows: DataFrame, bits: int) -> bytes:
    """A bitmap of the windows' shingles; of 2**bits bits whatever their number."""
    place = F.shiftrightunsigned("token", 64 - bits) + 1  # Spark's bitmaps count from 1
    parts = windows.select(F.explode("tokens").alias("token")).select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    out, width = bytearray((1 << bits) // 8), 4096
    for row in parts.toLocalIterator():  # (1 << bits) / 32768 rows at most
        out[(row["part"] - 1) * width : row["part"] * width] = row["bitmap"]
    return bytes(out)


RUN = pa.struct([("start", pa.int32()), ("width", pa.int32()), ("words", pa.list_(pa.string())), ("tokens", pa.list_(pa.int64()))])
RUN_DDL = "array<struct<start:int, width:int, words:array<string>, tokens:array<long>>>"


def hits(docs: DataFrame, bitmap, needed: dict[int, int], bits: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, runs) of each document.

    ``needed``: for each width of shingles how many neighbours a window of that width has at least.
    """

    def run(batches):
        known = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for rows, texts in text_parts(batch):
                runs: list[list] = [[] for _ in range(rows.num_rows)]
                for width, least in needed.items():
                    value, whole = texts.shingles(width)
                    place = value >> np.uint64(64 - bits)
                    met = np.flatnonzero(whole & ((known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool))
                    if not len(met):
                        continue
                    owner = np.searchsorted(texts.first, met, side="right") - 1
                    edge = np.flatnonzero((np.diff(met) > 1) | (np.diff(owner) > 0)) + 1
                    for s, e in zip(np.r_[0, edge].tolist(), np.r_[edge, len(met)].tolist()):
                        if e - s >= least:
                            first = int(met[s])
                            runs[owner[s]].append({
                                "start": first - int(texts.first[owner[s]]), "width": width,
                                "words": texts.words(first, first + e - s + width - 1),
                                "tokens": value[first : first + e - s].view(np.int64).tolist()})
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), rows.column("doc_id"), pa.array(np.diff(texts.first), pa.int64()), pa.array(runs, pa.list_(RUN))],
                    names=["row", "doc_id", "n_words", "runs"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                        text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, f"row long, doc_id long, n_words long, runs {RUN_DDL}")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    windows = scratch.table("windows", windows_of(items, window, shingle, item_col, item_text_col))
    shortest = windows.groupBy(F.least("length", F.lit(shingle)).alias("width")).agg(F.min("length").alias("length"))
    needed = {r["width"]: r["length"] - r["width"] + 1 for r in shortest.collect()}  # a row for each width
    bitmap = spark.sparkContext.broadcast(shingle_filter(windows, filter_bits))
    found = scratch.table("hits", hits(docs, bitmap, needed, filter_bits, id_col, text_col))
    runs = found.select("row", F.explode("runs").alias("run")).select("row", "run.*")

    counts = runs.select(F.explode("tokens").alias("token")).groupBy("token").count()
    distinct = windows.groupBy("words").agg(F.first("length").alias("length"), F.first("tokens").alias("tokens"))
    shingles = distinct.select("words", "length", F.size("tokens").alias("all"), F.posexplode("tokens").alias("offset", "token"))
    # a window with a shingle that no document has is in none
    rarest = shingles.join(counts, "token").groupBy("words", "length", "all").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("count", "token", "offset")).alias("least")).filter("n = all")
    prefixes = scratch.table("prefixes", rarest.select(
        F.col("words").alias("window"), "length", F.col("least.token").alias("token"), F.col("least.offset").alias("offset")))

    # of a run's words those that a window around the shingle can hold
    before = F.least(F.col("at"), window - F.col("width"))
    places = runs.select("row", "start", "width", "words", F.posexplode("tokens").alias("at", "token")).select(
        "row", "token", (F.col("start") + F.col("at")).alias("place"), before.alias("before"),
        F.slice("words", F.col("at") - before + 1, F.lit(2 * window)).alias("words"))
    fits = (F.col("offset") <= F.col("before")) & (F.col("before") - F.col("offset") + F.col("length") <= F.size("words"))
    same = F.array_join(F.slice("words", F.col("before") - F.col("offset") + 1, F.col("length")), " ") == F.col("window")
    met = scratch.table("met", places.join(prefixes, "token").filter(fits & same).select(
        "row", "window", (F.col("place") - F.col("offset")).alias("start"), (F.col("place") - F.col("offset") + F.col("length")).alias("end")))

    spans = F.sort_array(F.collect_set(F.struct("start", "end")))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (
            a["n"] + F.greatest(s["end"] - F.greatest(a["to"], s["start"]), F.lit(0))).alias("n")))
    hit = met.groupBy("row").agg(covered["n"].alias("n_hit"))
    members = windows.select(F.col("words").alias("window"), "item").distinct()
    listed = met.select("row", "window").distinct().join(members, "window").select("row", "item").distinct().groupBy("row").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    nothing = F.lit(0).cast("long")
    return found.select("row", "doc_id", "n_words").join(hit, "row", "left").join(listed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", nothing).alias("n_hit"), F.coalesce("n_items", nothing).alias("n_items"),
        F.coalesce("items_sha256", F.lit(NOTHING)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of which no word is in a window of an item; of an id's rows all go if one is hit."""
    hit = contamination(docs, items, id_col=id_col, **options).filter("contaminated").select("doc_id").distinct()
    return docs.join(hit, docs[id_col].eqNullSafe(hit["doc_id"]), "left_anti")
