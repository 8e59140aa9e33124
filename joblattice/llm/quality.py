"""Quality scores by a linear support vector machine on Naive Bayes features.

Features are indicators of hashed n-grams: single words, pairs of words, and one to three
neighbouring word shapes (case and kinds of characters, or a mark where a word repeats the one
before). Each indicator is scaled by its log-count ratio between the classes; a hinge-loss
model is then fitted by dual coordinate descent. A logistic curve, fitted on margins of rows
that the fitting model has not seen, turns margins into scores.

The fit takes a bounded sample of labelled rows (``sample_rows``, those with the least hash of
their id, so a repeated fit takes the same) and runs in one task; whole texts are read. Every
document is scored from its whole text alone.

Null and empty texts have no n-grams and get the score of the model's intercept. Null labels
and labels without a document are not learned from. Where an id has several labelled rows, each
counts. Without any label, or with one class only, the score is the share of label 1 (1 where
there is none). Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import held, text_or_empty
from joblattice.llm.tokens import slices

BITS = 18
BUCKETS = 1 << BITS
KEPT = 300_000
SALTS = tuple(np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def mixed(values: np.ndarray) -> np.ndarray:
    """A finalising hash of unsigned 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def fingerprint(text: str) -> int:
    """The same 64 bits in every process."""
    value = 0xCBF29CE484222325
    for byte in text.encode("utf-8", "surrogatepass"):
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def shape(word: str) -> str:
    """Case and kinds of characters, runs shortened: ``Xx``, ``X!``, ``x,``, ``9``."""
    kinds: list[str] = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if kinds[-2:] != [kind, kind]:
            kinds.append(kind)
    return "".join(kinds[:12])


class Featurizer:
    """Distinct hashed n-grams of a text. Hashes of known words are kept, ``KEPT`` at most."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.shapes: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > KEPT:
            self.words.clear()
            self.shapes.clear()
        for word in set(words):
            if word not in self.words:
                self.words[word] = fingerprint(word)
                self.shapes[word] = fingerprint("shape " + shape(word))
        count = len(words)
        return (
            np.fromiter(map(self.words.__getitem__, words), np.uint64, count),
            np.fromiter(map(self.shapes.__getitem__, words), np.uint64, count),
        )

    def __call__(self, text: str) -> np.ndarray:
        words, shapes = self._hashes(text.split())
        if not len(words):
            return np.zeros(0, np.int64)
        shapes[1:][words[1:] == words[:-1]] = SALTS[3]
        grams = [words, words[:-1] * SALTS[0] + words[1:]]
        grams += [shapes, shapes[:-1] * SALTS[1] + shapes[1:]]
        grams.append((shapes[:-2] * SALTS[1] + shapes[1:-1]) * SALTS[2] + shapes[2:])
        return np.unique(mixed(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int64)


def featurizer() -> Featurizer:
    return held(Featurizer)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of an indicator, its log-count ratio included
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        """Averaged over the indicators, so that long texts are judged like short ones."""
        margin = self.weights[features].sum() / max(1.0, math.sqrt(len(features))) + self.bias
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * margin + self.shift))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, BUCKETS), smoothing)
    for features, label in zip(rows, labels):
        counts[int(label), features] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over scaled indicators.

    Row i holds the values of ratio / sqrt(length); its dual variable stays within 0 and cost.
    """
    ratio = log_count_ratio(rows, labels)
    values = [ratio[f] / max(1.0, math.sqrt(len(f))) for f in rows]
    squares = np.array([float(v @ v) + 1.0 for v in values])
    signs = np.where(labels > 0, 1.0, -1.0)
    # a class that is seldom labelled weighs as much as the other
    share = np.array([np.mean(signs < 0), np.mean(signs > 0)])
    limits = cost * 0.5 / share[(signs > 0).astype(int)]
    weights, bias, dual = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            gradient = signs[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1.0
            following = min(max(dual[i] - gradient / squares[i], 0.0), limits[i])
            step = (following - dual[i]) * signs[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                dual[i] = following
                moved = max(moved, abs(step))
        if moved < 1e-2:
            break
    return weights * ratio, bias


def logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    point, design = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ point, -50, 50)))
        hessian = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (p - target))
        point = point - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(point[0]), float(point[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 8, folds: int = 3) -> Model:
    ones = labels.sum()
    if not 0 < ones < len(labels):
        share = ones / len(labels) if len(labels) else 1.0
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 50.0 if share >= 1 else -50.0)
    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % folds
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        if not 0 < labels[inside].sum() < len(inside):
            continue
        weights, bias = dual_coordinate_descent([rows[i] for i in inside], labels[inside], cost, rounds)
        for i in np.flatnonzero(fold == k):
            margins[i] = weights[rows[i]].sum() / max(1.0, math.sqrt(len(rows[i]))) + bias
    weights, bias = dual_coordinate_descent(rows, labels, cost, rounds)
    return Model(weights, bias, *logistic(margins, labels))


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: a fifth of the ids, by CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 6_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Fit on ``sample_rows`` labelled rows at most, outside the held-out fifth."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    chosen = texts.join(F.broadcast(sample), "id")  # at most sample_rows of two numbers

    def features(batches):
        own = featurizer()
        for batch in batches:
            for part in slices(batch):
                found = [own(t).astype("<i4").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array(found, pa.binary())], names=["id", "label", "features"])

    def fitted(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort()
        found = [np.frombuffer(f, "<i4").astype(np.int64) for _, _, f in rows]
        model = fit(found, np.array([y for _, y, _ in rows], float))
        scales = np.array([model.bias, model.slope, model.shift])
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.astype("<f8").tobytes()]), pa.array([scales.astype("<f8").tobytes()])],
            names=["weights", "scales"])

    rows = chosen.select("id", "label", "text").mapInArrow(features, "id long, label int, features binary")
    # one task: the sample is bounded, and so is the model that comes back
    found = rows.repartition(1).mapInArrow(fitted, "weights binary, scales binary").first()
    if found is None:  # not a row to learn from
        return fit([], np.zeros(0))
    return Model(np.frombuffer(found["weights"], "<f8"), *np.frombuffer(found["scales"], "<f8").tolist())


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per n-gram bucket

    def run(batches):
        own, judge = featurizer(), shared.value
        for batch in batches:
            for part in slices(batch):
                scores = np.array([judge.score(own(t)) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                    names=[id_col, "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"{id_col} long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        own, judge = featurizer(), shared.value
        for batch in batches:
            for part in slices(batch):
                good = [judge.score(own(t or "")) >= threshold for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
