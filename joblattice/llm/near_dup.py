"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the multiset of its runs of five words (lower case, cut at white space; a shorter text
is one run). Each distinct run meets the registers of a signature as a Poisson process whose
rate is the run's number of occurrences; a register keeps its earliest arrival, and a process
ends when its next arrival is later than every register. Equal registers then estimate the
probability Jaccard similarity. A second signature with all rates equal, which estimates the
plain Jaccard similarity, is formed where a run repeats. Bands of registers bring texts
together; a link is a pair whose probability Jaccard or plain Jaccard, computed from all runs,
is at least ``similarity``.

Texts of equal words are one node. A bucket of a band compares its nodes with a hub: the node
whose buckets hold the most nodes, which in a family of edited copies is the text they stem
from. Nodes without a link to the hub get a hub among themselves, ``rounds``
times over. Last, the nodes of buckets that still hold several classes are joined by the rare ones
of their runs (``crossing``), which finds every link between two classes; a class that its hubs hold
together costs no comparison more. The chance that a pair at the threshold shares
no bucket is (1 - s**4)**24, about 3 in a million.

Null texts and texts without words are alone in their class. Null ids take part; a class has
the least id that isn't null. Repeated rows are copies like any other. Extra columns are
ignored by ``classes`` and kept by ``keep_first``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch, connected_classes, held, text_or_empty
from joblattice.llm.quality import mixed
from joblattice.llm.tokens import slices

WORDS = 5
BANDS, ROWS, ROUNDS = 24, 4, 3
KEPT = 400_000
STEP = np.uint64(0x9E3779B97F4A7C15)
PRIME = np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Hashed runs of words of several texts at once. Word hashes are kept, ``KEPT`` at most."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, run, occurrences), sorted by text and run."""
        known, hashed = self.known, xxhash.xxh3_64_intdigest
        if len(known) > KEPT:
            known.clear()
        for words in texts:
            for word in set(words):
                if word not in known:
                    known[word] = hashed(word)
        lengths = np.array([len(w) for w in texts], np.int64)
        word = np.fromiter((known[w] for words in texts for w in words), np.uint64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        run = np.zeros(len(word), np.uint64)
        # run i starts at word i; texts shorter than a run give one run of what they have
        last = np.repeat(np.cumsum(lengths), lengths)
        at = np.arange(len(word))
        for k in range(self.words):
            inside = at + k < last
            run = run * PRIME
            run[inside] += word[(at + k)[inside]]
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        whole = (at + self.words <= last) | (at == first)
        owner, run = owner[whole], mixed(run[whole] + STEP)
        order = np.lexsort((run, owner))
        owner, run = owner[order], run[order]
        start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (run[1:] != run[:-1])][: len(run)])
        counts = np.diff(np.r_[start, len(run)])
        return owner[start], run[start], counts


def signatures(owner: np.ndarray, run: np.ndarray, rate: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Registers of each text: the run with the earliest arrival."""
    earliest = np.full(texts * registers, np.inf)
    chosen = np.zeros(texts * registers, np.uint64)
    arrival, rate = np.zeros(len(run)), rate.astype(float)
    latest, step = np.full(texts, np.inf), np.zeros(1, np.uint64)
    while len(run):
        step += STEP
        draw = mixed(run ^ mixed(step))
        arrival = arrival - np.log(((draw >> np.uint64(12)) + np.uint64(1)).astype(float) * 2.0**-52) / rate
        alive = arrival < latest[owner]  # else this and all later arrivals come too late
        owner, run, rate, arrival, draw = owner[alive], run[alive], rate[alive], arrival[alive], draw[alive]
        place = owner * registers + (mixed(draw * PRIME) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, place, arrival)
        first = earliest[place] == arrival
        chosen[place[first]] = run[first]
        latest = earliest.reshape(texts, registers).max(axis=1)
    return chosen.reshape(texts, registers)


def band_keys(chosen: np.ndarray, bands: int) -> np.ndarray:
    rows = chosen.shape[1] // bands
    parts = chosen.reshape(len(chosen), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * STEP
    for r in range(rows):
        key = mixed(key * PRIME + parts[:, :, r])
    return key.view(np.int64)


def similarity_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(probability Jaccard, plain Jaccard) of two sorted lists of runs with their occurrences."""
    (runs_a, count_a), (runs_b, count_b) = a, b
    union = np.union1d(runs_a, runs_b)
    shared = len(runs_a) + len(runs_b) - len(union)
    plain = shared / max(1, len(union))
    if not shared or count_a.max() == 1 == count_b.max():
        return plain, plain
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, runs_a)] = count_a
    y[np.searchsorted(union, runs_b)] = count_b
    # for a shared run d: the sum over all runs of max(x / x_d, y / y_d), by sorted ratio
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    below = np.r_[0.0, np.cumsum(y)]
    above = np.r_[np.cumsum(x[::-1])[::-1], 0.0]
    both = np.flatnonzero((x > 0) & (y > 0))
    cut = np.searchsorted(ratio, ratio[both], side="right")
    return float((1.0 / (above[cut] / x[both] + below[cut] / y[both])).sum()), plain


def shingler(words: int) -> Shingler:
    return held(Shingler, words)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def digest_of(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def features(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(key, doc_id, digest, size, repeats, bands) of each row; no digest where there are no words.

    ``size`` is the number of distinct runs; ``repeats`` says whether one of them repeats.
    """

    def run(batches):
        own = shingler(words)
        for batch in batches:
            for part in slices(batch):
                split = [t.lower().split() for t in part.column("text").to_pylist()]
                owner, run_, count = own(split)
                chosen = signatures(owner, run_, count, len(split), bands * rows)
                keys = band_keys(chosen, bands).tolist()
                repeats = np.unique(owner[count > 1])
                repeating = np.zeros(len(split), bool)
                repeating[repeats] = True
                if len(repeats):
                    some = np.isin(owner, repeats)
                    plain = signatures(np.searchsorted(repeats, owner[some]), run_[some], np.ones(int(some.sum())), len(repeats), bands * rows)
                    for i, more in zip(repeats.tolist(), band_keys(plain, bands).tolist()):
                        keys[i] = list({*keys[i], *more})
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"),
                     pa.array([digest_of(w) if w else None for w in split], pa.binary()),
                     pa.array(np.bincount(owner, minlength=len(split)), pa.int64()), pa.array(repeating),
                     pa.array([k if w else None for k, w in zip(keys, split)], pa.list_(pa.int64()))],
                    names=["key", "doc_id", "digest", "size", "repeats", "bands"])

    selected = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                           text_or_empty(text_col).alias("text"))
    return selected.mapInArrow(run, "key long, doc_id long, digest binary, size long, repeats boolean, bands array<long>")


def run_lists(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(digest, runs, counts) of the texts whose row key is in ``wanted(key)``."""

    def run(batches):
        own = shingler(words)
        for batch in batches:
            for part in slices(batch):
                split = [t.lower().split() for t in part.column("text").to_pylist()]
                owner, run_, count = own(split)
                bounds = np.searchsorted(owner, np.arange(len(split) + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest_of(w) for w in split]),
                     pa.array([run_[s:e].astype("<u8").tobytes() for s, e in zip(bounds[:-1], bounds[1:])], pa.binary()),
                     pa.array([count[s:e].astype("<u4").tobytes() if (count[s:e] > 1).any() else None
                               for s, e in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["digest", "runs", "counts"])

    texts = docs.select(row_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    return texts.join(wanted.hint("merge"), "key", "left_semi").select("text").mapInArrow(
        run, "digest binary, runs binary, counts binary").dropDuplicates(["digest"])


def compared(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b, weighted, plain): both similarities of each pair."""

    def unpack(runs, counts):
        runs = np.frombuffer(runs, "<u8")
        return runs, np.ones(len(runs), np.uint32) if counts is None else np.frombuffer(counts, "<u4")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [similarity_of(unpack(ra, ca), unpack(rb, cb)) for ra, ca, rb, cb in zip(
                    *(part.column(c).to_pylist() for c in ("runs_a", "counts_a", "runs_b", "counts_b")))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array([w for w, _ in found], pa.float64()),
                     pa.array([p for _, p in found], pa.float64())], names=["a", "b", "weighted", "plain"])

    def side(name):
        return lists.select(F.col("digest").alias(name), F.col("runs").alias(f"runs_{name}"), F.col("counts").alias(f"counts_{name}"))

    return pairs.hint("merge").join(side("a"), "a").join(side("b").hint("merge"), "b").select(
        "a", "b", "runs_a", "counts_a", "runs_b", "counts_b").mapInArrow(run, "a binary, b binary, weighted double, plain double")


def run_rows(lists: DataFrame) -> DataFrame:
    """(digest, run, count) of each distinct run of the texts in ``lists``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                for digest, runs, counts in zip(*(part.column(c).to_pylist() for c in ("digest", "runs", "counts"))):
                    values = np.frombuffer(runs, "<u8").view(np.int64)
                    often = np.ones(len(values), np.int32) if counts is None else np.frombuffer(counts, "<u4").astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest] * len(values), pa.binary()), pa.array(values), pa.array(often)], names=["digest", "run", "count"])

    return lists.mapInArrow(run, "digest binary, run long, count int")


def crossing(members: DataFrame, roots: DataFrame, lists: DataFrame, measured: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """(a, b) of the nodes of two classes that may be linked, of all nodes in buckets with several classes.

    A prefix-filtered join over the nodes' runs in order of rarity. Let s be the similarity, and u the share
    of occurrences that lie in runs of one text only, added up over both texts. A plain Jaccard of s needs
    s / (1 + s) of both numbers of runs in common. A probability Jaccard of s needs a total variation v of 1 - s at
    most, and is 1 - u / (1 + v) at most, so it needs a u of (1 - s) (2 - s) at most. What comes before the
    first common run is not common, so that run lies in both texts' prefixes, its place leaves room for the
    rest, and in one of the two it comes within half of what may be missing (it is early there). Early rows
    meet all rows of their run; no pair that reaches the similarity is lost.
    """
    missing, apart = (1 - similarity) * (2 - similarity) + 1e-9, (1 - similarity) / (1 + similarity) + 1e-9
    rows = members.select("band", "digest", "size", "repeats").join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left")
    rows = rows.withColumn("root", F.coalesce("root", "digest"))
    several = rows.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("band")
    nodes = scratch.table("classed", rows.join(several, "band", "left_semi").select("digest", "size", "repeats", "root").distinct())
    runs = scratch.table("runs", run_rows(lists.join(nodes.select("digest"), "digest", "left_semi")))
    rarity = runs.groupBy("run").agg(F.count(F.lit(1)).alias("often"))
    ordered = Window.partitionBy("digest").orderBy("often", "run")
    placed = runs.join(rarity, "run").withColumns({
        "before": F.row_number().over(ordered) - 1,
        "mass": F.sum("count").over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
        "total": F.sum("count").over(Window.partitionBy("digest")),
    }).withColumn("share", F.coalesce("mass", F.lit(0)) / F.col("total"))
    prefix = placed.join(nodes, "digest").filter(
        (F.col("often") > 1) & ((F.col("before") <= (1 - similarity + 1e-9) * F.col("size")) | (F.col("share") <= missing)))
    prefix = scratch.table("prefixes", prefix.select(
        "run", "digest", "root", "size", "repeats", "before", "share",
        ((F.col("before") <= apart * F.col("size")) | (F.col("share") <= missing / 2)).alias("early")))
    met = prefix.groupBy("run").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("run")
    mixed_ = prefix.join(met, "run", "left_semi")
    x, y = mixed_.filter("early").alias("x"), mixed_.alias("y")
    fits = F.least("x.size", "y.size") >= (similarity - 1e-9) * F.greatest("x.size", "y.size")
    left = F.least(F.col("x.size") - F.col("x.before"), F.col("y.size") - F.col("y.before"))
    plain = fits & (left >= (similarity / (1 + similarity) - 1e-9) * (F.col("x.size") + F.col("y.size")))
    # without repeated runs both similarities are one
    weighted = (F.col("x.repeats") | F.col("y.repeats")) & (F.col("x.share") + F.col("y.share") <= missing)
    once = ~F.col("y.early") | (F.col("x.digest") < F.col("y.digest"))
    found = x.join(y, (F.col("x.run") == F.col("y.run")) & (F.col("x.root") != F.col("y.root")) & once & (plain | weighted))
    pairs = found.select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b")).distinct()
    return pairs.join(measured, ["a", "b"], "left_anti")


def links_of(
    docs: DataFrame, found: DataFrame, scratch: Scratch, id_col: str, text_col: str, words: int, similarity: float, rounds: int,
) -> DataFrame:
    """(a, b) of the linked texts, enough of them that no two linked texts of a bucket are in different classes."""
    linked = (F.col("weighted") >= similarity) | (F.col("plain") >= similarity)
    slots = scratch.table("slots", found.filter("digest is not null").groupBy("digest").agg(
        F.min("key").alias("key"), F.first("size").alias("size"), F.first("repeats").alias("repeats"),
        F.first("bands").alias("bands")).select("digest", "key", "size", "repeats", F.explode("bands").alias("band")))
    sizes = slots.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = scratch.table("members0", slots.join(sizes, "band"))
    scratch.drop("slots")
    lists = scratch.table("lists", run_lists(docs, members.select("key").distinct(), id_col, text_col, words))
    weights = members.groupBy("digest").agg(F.sum("n").alias("weight"))
    waiting = scratch.table("waiting0", members.select("band", "digest", "size", "repeats").join(weights, "digest"))
    members, measured = None, None
    for number in range(1, max(1, rounds) + 1):
        hubs = waiting.groupBy("band").agg(F.max(F.struct("weight", "digest"))["digest"].alias("hub"))
        rows = scratch.table(f"members{number}", waiting.join(hubs, "band"))
        members = rows if members is None else members
        beside = rows.filter("digest <> hub")
        pairs = beside.select(F.least("digest", "hub").alias("a"), F.greatest("digest", "hub").alias("b")).distinct()
        if measured is not None:
            pairs = pairs.join(measured, ["a", "b"], "left_anti")
        fresh = scratch.table(f"fresh{number}", compared(pairs, lists))
        measured = fresh if measured is None else measured.union(fresh)
        if number < rounds:
            near = measured.filter(linked).select("a", "b")
            near = near.union(near.select("b", "a")).toDF("digest", "hub")
            left = beside.join(near, ["digest", "hub"], "left_anti").select("band", "digest", "size", "repeats", "weight")
            # a node that is left alone in its bucket has nothing to meet before the last step
            several = left.groupBy("band").count().filter("count > 1").select("band")
            waiting = scratch.table(f"waiting{number}", left.join(several, "band", "left_semi"))
    links = measured.filter(linked).select("a", "b")
    roots = scratch.table("roots0", connected_classes(links, scratch))
    last = scratch.table("last", compared(scratch.table("crossing", crossing(members, roots, lists, measured, scratch, similarity)), lists))
    return links.union(last.filter(linked).select("a", "b"))


def _classed(docs, id_col, text_col, words, bands, rows, similarity, rounds):
    scratch = Scratch(docs.sparkSession)
    found = scratch.table("features", features(docs, id_col, text_col, words, bands, rows))
    links = scratch.table("links", links_of(docs, found, scratch, id_col, text_col, words, similarity, rounds))
    roots = scratch.table("roots", connected_classes(links, scratch))
    scratch.drop("lists", "roots0", "classed", "runs", "prefixes", "crossing", "last", *(
        f"{n}{i}" for i in range(max(1, rounds) + 1) for n in ("waiting", "members", "fresh")))
    degree = links.union(links.select("b", "a")).groupBy(F.col("a").alias("digest")).agg(F.count(F.lit(1)).alias("n_found_links"))
    nodes = found.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    nodes = nodes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").join(degree, "digest", "left").select(
        "digest", "least", F.coalesce("root", "digest").alias("root"), F.coalesce("n_found_links", F.lit(0)).alias("n_found_links"))
    heads = nodes.groupBy("root").agg(F.min("least").alias("head"))
    return found.select("key", "doc_id", "digest"), scratch.table("nodes", nodes.join(heads, "root").select("digest", "head", "n_found_links"))


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS,
    rows: int = ROWS, similarity: float = 0.8, rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, class_id, n_found_links) of every row.

    ``class_id`` is the least id of the class; ``n_found_links`` counts the links of the row's
    text to other texts that were verified to hold its class together, not all there are.
    """
    found, nodes = _classed(docs, id_col, text_col, words, bands, rows, similarity, rounds)
    return found.join(nodes, "digest", "left").select(
        "doc_id",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_found_links", F.lit(0)).cast("long").alias("n_found_links"),
    )


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS,
    rows: int = ROWS, similarity: float = 0.8, rounds: int = ROUNDS,
) -> DataFrame:
    """The documents without all but the first of each class; texts without words all stay."""
    found, nodes = _classed(docs, id_col, text_col, words, bands, rows, similarity, rounds)
    heads = nodes.select(F.col("head.key").alias("__head")).distinct()
    alone = found.filter("digest is null").select(F.col("key").alias("__head")).distinct()
    keyed = docs.withColumn("__head", row_key(id_col, text_col))
    first = keyed.join(heads.hint("merge"), "__head", "left_semi").dropDuplicates(["__head"])
    return first.unionByName(keyed.join(alone.hint("merge"), "__head", "left_semi")).drop("__head")
