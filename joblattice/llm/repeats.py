"""Removal of long byte strings that occur more than once anywhere in the corpus.

A byte goes if some string of ``window`` bytes that covers it also starts elsewhere, in the same
text or another; strings are judged on the input and never cross texts.

Prefix polynomial hashes of a text give the hash of any of its substrings in constant time. Not
all suffixes are sorted: each window is filed under an anchor, the place of the least hash of
``GRAM`` bytes among its first 256 places, which depends on the window's content alone, so
equal windows have equal anchors at equal distances. An anchor stands for a block of window
starts. The block is settled by a search from coarse to fine (256, 16, 1 starts):

* Bytes that all windows of a block share occur nowhere else: no window of the block repeats.
* Bytes that the windows of a block cover together occur elsewhere too: all of them repeat.
* Else the block is cut into 16, and so is one block of each kind that it may match.

Equality is decided by two independent hashes of 64 and 62 bits, the second one the check of the
first. Spark counts equal blocks with partial aggregates and plain joins, so that thousands of
copies of a passage meet nowhere.

Null texts are empty; texts shorter than a window stay whole. Repeated rows repeat each other:
they lose all windows. Null ids take part. Extra columns are ignored by ``digests`` and kept by
``without_repeats``. An empty table gives no rows. Rows are told apart by a 64-bit hash of id
and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch, held, text_or_empty
from joblattice.llm.quality import mixed

WINDOW, STARTS, PART = 400, 256, 16
# A slice takes some 200 bytes of memory for each of its bytes: prefix hashes, powers, candidate anchors.
SLICE_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
# Primes below 2**31 and a base for each.
PRIMES = ((2147483647, 1103515245), (2147483629, 1299709))
SITES = "key long, site long, lo int, inner long, outer long"


class Powers:
    """Powers of the bases and their inverses, grown to the longest text met."""

    def __init__(self):
        self.size = 0

    def upto(self, size: int) -> Powers:
        if size <= self.size:
            return self
        self.size = max(size, 2 * self.size)
        self.wrap = self._wrapped(BASE)
        self.unwrap = self._wrapped(pow(BASE, -1, 1 << 64))
        self.up = [self._modulo(base, prime) for prime, base in PRIMES]
        self.down = [self._modulo(pow(base, -1, prime), prime) for prime, base in PRIMES]
        return self

    def _wrapped(self, base: int) -> np.ndarray:
        steps = np.full(self.size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def _modulo(self, base: int, prime: int) -> np.ndarray:
        out, filled = np.ones(self.size, np.uint64), 1
        while filled < self.size:
            more = min(filled, self.size - filled)
            out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, prime)) % np.uint64(prime)
            filled += more
        return out


def powers() -> Powers:
    return held(Powers)


class Prefixes:
    """Prefix hashes of a buffer of bytes; hashes of [start, end) for arrays of places."""

    def __init__(self, content: bytes):
        data = np.frombuffer(content, np.uint8).astype(np.uint64) + np.uint64(1)
        self.powers = powers().upto(len(data) + 1)
        count = len(data)
        self.wrapped = np.zeros(count + 1, np.uint64)
        np.cumsum(data * self.powers.wrap[:count], out=self.wrapped[1:])
        self.sums = []
        for (prime, _), up in zip(PRIMES, self.powers.up):
            total = np.zeros(count + 1, np.uint64)
            np.cumsum(data * up[:count] % np.uint64(prime), out=total[1:])
            self.sums.append(total)

    def first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.wrapped[end] - self.wrapped[start]) * self.powers.unwrap[start]
        return mixed(value + (end - start).astype(np.uint64))

    def second(self, start: np.ndarray, end: np.ndarray, mark: np.ndarray) -> np.ndarray:
        parts = []
        for (prime, _), total, down in zip(PRIMES, self.sums, self.powers.down):
            parts.append((total[end] - total[start]) % np.uint64(prime) * down[start] % np.uint64(prime))
        return mixed(((parts[0] << np.uint64(31)) | parts[1]) ^ mixed(mark.astype(np.uint64)))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from minima within blocks of that width."""
    count = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(prefixes: Prefixes, offsets: np.ndarray, window: int):
    """(text number, place, first start, last start) of each anchor in a buffer of texts."""
    size, gram = int(offsets[-1]), window - STARTS + 1
    if size < window:
        return (np.zeros(0, np.int64),) * 4
    places = np.arange(size - gram + 1)
    value = (prefixes.wrapped[gram:] - prefixes.wrapped[:-gram]) * prefixes.powers.unwrap[: len(places)]
    # the leftmost of equal hashes
    keyed = (mixed(value) & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    place = (sliding_least(keyed, STARTS) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(place))
    text = np.searchsorted(offsets, start, side="right") - 1
    inside = start + window <= offsets[text + 1]
    place, start, text = place[inside], start[inside], text[inside]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    change = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]
    begin = np.flatnonzero(change)
    last = np.r_[begin[1:], len(start)] - 1
    return text[begin], place[begin], start[begin], start[last]


def blocks_of(prefixes: Prefixes, offsets, text, place, lo, width: int, window: int):
    """Hashes of what the windows of each block share and of what they cover in their text."""
    hi = lo + width - 1
    inner = prefixes.first(place - lo, place - hi + window)
    start = np.maximum(place - hi, offsets[text])
    end = np.minimum(place - lo + window, offsets[text + 1])
    mark = (place - start) * 4096 + (end - place)  # where the anchor lies in it
    return inner.view(np.int64), prefixes.second(start, end, mark).view(np.int64)


def site_of(place, first, last):
    """Place, nearest and farthest start of an anchor in one number."""
    return (place << 16) | ((place - last) << 8) | (place - first)


def buffers(batches):
    """Batches with a binary column ``content`` in slices of about ``SLICE_BYTES``."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("content")).to_pylist()
        at = held = 0
        for i, size in enumerate(sizes):
            held += size
            if held >= SLICE_BYTES or i + 1 == len(sizes):
                yield batch.slice(at, i + 1 - at), np.r_[0, np.cumsum(sizes[at : i + 1])].astype(np.int64)
                at, held = i + 1, 0


def row_batch(key, site, lo, inner, outer) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    columns = [pa.array(c, k) for c, k in zip((key, site, lo, inner, outer), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "site", "lo", "inner", "outer"])


def coarse_blocks(texts: DataFrame, window: int) -> DataFrame:
    """One block of 256 starts for each anchor of (key, content)."""

    def run(batches):
        for part, offsets in buffers(batches):
            content = b"".join(part.column("content").to_pylist())
            prefixes = Prefixes(content)
            text, place, first, last = anchors(prefixes, offsets, window)
            if not len(text):
                continue
            lo = np.zeros(len(text), np.int64)
            inner, outer = blocks_of(prefixes, offsets, text, place, lo, STARTS, window)
            key = part.column("key").to_numpy()[text]
            yield row_batch(key, site_of(place - offsets[text], first - offsets[text], last - offsets[text]), lo, inner, outer)

    return texts.mapInArrow(run, SITES)


def finer_blocks(texts: DataFrame, width: int, window: int) -> DataFrame:
    """Blocks of ``width`` starts within the listed blocks of (key, content, sites, los)."""
    whole = width * PART

    def run(batches):
        for part, offsets in buffers(batches):
            prefixes = Prefixes(b"".join(part.column("content").to_pylist()))
            sites, los = part.column("sites"), part.column("los")
            counts = pc.list_value_length(sites).to_numpy()
            text = np.repeat(np.arange(len(counts)), counts)
            site = sites.flatten().to_numpy().astype(np.int64)
            lo = los.flatten().to_numpy().astype(np.int64)
            finer = (lo[:, None] + np.arange(0, whole, width)[None, :])
            near, far = (site >> 8) & 255, site & 255
            asked = (finer + width > near[:, None]) & (finer <= far[:, None])
            which, lo = np.nonzero(asked)[0], finer[asked]
            text, site = text[which], site[which]
            place = (site >> 16) + offsets[text]
            inner, outer = blocks_of(prefixes, offsets, text, place, lo, width, window)
            yield row_batch(part.column("key").to_numpy()[text], site, lo, inner, outer)

    return texts.mapInArrow(run, SITES)


def settle(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks that repeat, and blocks to be cut: (key, site, lo) each."""
    often = rows.groupBy("inner").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("inner")
    met = scratch.table(f"{name}-met", rows.join(often, "inner", "left_semi"))
    kinds = scratch.table(f"{name}-kinds", met.groupBy("inner", "outer").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "site", "lo")).alias("one")))
    repeated = met.join(kinds.filter("n > 1").select("inner", "outer"), ["inner", "outer"], "left_semi")
    several = kinds.groupBy("inner").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("inner")
    return repeated.select("key", "site", "lo"), kinds.join(several, "inner", "left_semi").select("one.*")


def spans_of(blocks: DataFrame, width: int, window: int) -> DataFrame:
    """(key, start, end) of the bytes that the windows of repeated blocks cover."""
    place = F.shiftright("site", 16)
    near = F.greatest(F.shiftright("site", 8).bitwiseAND(F.lit(255)), F.col("lo"))
    far = F.least(F.col("site").bitwiseAND(F.lit(255)), F.col("lo") + (width - 1))
    return blocks.filter(near <= far).select("key", (place - far).alias("start"), (place - near + window).alias("end"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def repeated_spans(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Scratch]:
    """Repeated spans of each row as (key, spans), and (key, content) of the rows that may have any."""
    scratch = Scratch(docs.sparkSession)
    content = docs.select(row_key(id_col, text_col).alias("key"), text_or_empty(text_col).cast("binary").alias("content"))
    content = content.filter(F.length("content") >= window)
    blocks = scratch.table("coarse", coarse_blocks(content, window))
    repeated, open_blocks = settle(blocks, scratch, "coarse")
    spans = scratch.table("spans0", spans_of(repeated, STARTS, window).distinct())
    scratch.drop("coarse")
    touched = scratch.spark.read.parquet(scratch.path("coarse-met")).select("key").distinct()
    texts = scratch.table("texts", content.join(touched.hint("merge"), "key", "left_semi"))
    width = STARTS
    while width > 1:
        width //= PART
        listed = open_blocks.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("site", "lo"))).alias("all")).select(
            "key", F.col("all.site").alias("sites"), F.col("all.lo").alias("los"))
        rows = scratch.table(f"blocks{width}", finer_blocks(texts.join(listed.hint("merge"), "key"), width, window))
        repeated, open_blocks = settle(rows, scratch, f"blocks{width}")
        spans = spans.union(scratch.table(f"spans{width}", spans_of(repeated, width, window).distinct()))
    gathered = spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all"))
    gathered = scratch.table("spans", gathered.select(
        "key", F.col("all.start").alias("starts"), F.col("all.end").alias("ends")))
    return gathered, texts, scratch


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Spans sorted by start, joined where they overlap or touch."""
    out: list[list[int]] = []
    for start, end in zip(starts, ends):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def kept_bytes(content: bytes, spans: list[tuple[int, int]]) -> bytes:
    bounds = [0, *(x for span in spans for x in span), len(content)]
    return b"".join(content[s:e] for s, e in zip(bounds[::2], bounds[1::2]))


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    spans, texts, scratch = repeated_spans(docs, window, id_col, text_col)

    def run(batches):
        for batch in batches:
            rows = []
            for key, content, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                own = merged(starts, ends)
                kept = kept_bytes(content, own)
                rows.append((key, len(content) - len(kept), len(own), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "n_removed", "n_spans", "kept"])

    changed = texts.join(spans.hint("merge"), "key").select("key", "content", "starts", "ends").mapInArrow(
        run, "key long, n_removed long, n_spans long, kept string").dropDuplicates(["key"])
    content = text_or_empty(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"),
        F.length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("whole"))
    return rows.join(changed, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated bytes taken out of the text.

    Characters of which only a part is repeated stay.
    """
    spans, _, scratch = repeated_spans(docs, window, id_col, text_col)
    names, schema = docs.columns, docs.schema
    place = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in (text_col, "__starts", "__ends"))):
                if starts:
                    content, own = text.encode(), []
                    for start, end in merged(starts, ends):
                        while start < end and content[start] & 0xC0 == 0x80:
                            start += 1
                        while end < len(content) and end > start and content[end] & 0xC0 == 0x80:
                            end -= 1
                        own.append((start, end))
                    text = kept_bytes(content, own).decode()
                texts.append(text)
            own = batch.select(names)
            yield own.set_column(place, own.schema.field(place), pa.array(texts, own.schema.field(place).type))

    found = spans.select(F.col("key").alias("__key"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    return docs.withColumn("__key", row_key(id_col, text_col)).join(found.hint("merge"), "__key", "left").select(
        *names, "__starts", "__ends").mapInArrow(run, schema)
