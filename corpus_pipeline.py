"""Raw documents to packed training sequences.

Five stages, each one operator of ``joblattice.llm``. A stage takes what the one before it
kept, as Parquet, and returns the documents' columns; the last returns the packed pieces.

1. Quality classifier: documents with a score under 0.3 go.
2. Line dedup: later copies of repeated runs of two lines or more, and of single lines of 20 words
   or more, are deleted; a document of which no line is left goes.
3. MinHash near-dedup: of each class of near-duplicates the document with the least id stays.
4. Suffix-array dedup: every byte within a repeated string of 400 bytes is cut out.
5. Best-fit packing: all documents in sequences of at most 2048 tokens.

``n_chars`` follows the text where a stage changes it. Nulls, empty texts, repeated rows and
empty tables are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm import line_runs, near_dup, packing, quality, repeats
from joblattice.llm.common import Scratch
from joblattice.session import prepare


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _counted(line_runs.without_runs(docs, long_words=20))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dup.keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _counted(repeats.without_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("best_fit_packing", pack),
]

# The classifier's training, verified similarity and tokenizing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read by the next."""
    scratch = Scratch(spark)
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
