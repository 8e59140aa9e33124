"""Table schemas and the source catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("company", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("location", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("posted_at", T.StringType(), True),
        T.StructField("skills", T.ArrayType(T.StringType()), False),
        T.StructField("confidence", T.DoubleType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("ingested_at", T.TimestampType(), False),
    ]
)
LISTING_COLUMNS = LISTING_SCHEMA.fieldNames()

# What an adapter hands to ingest. ``fetched`` counts towards the run's fetched total;
# ``matched`` rows go on to validation, the others only carry their count.
RAW_COLUMNS = [
    "title", "company", "url", "description", "location", "source", "posted_at",
    "seq", "pos", "fetched", "matched",
]

CAPTURE_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("kind", T.StringType()),  # feed | sitemap | search | board | page
        T.StructField("board", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

SEARCH_RECORD_COLUMNS = [
    "source", "url", "title", "company", "location", "posted_at", "description", "seq", "pos",
]

SEARCH_RECORD_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in SEARCH_RECORD_COLUMNS[:-2]]
    + [T.StructField("seq", T.LongType()), T.StructField("pos", T.IntegerType())]
)

# A search result as found: one without a link is no record and only counts.
FOUND_SCHEMA = T.StructType([*SEARCH_RECORD_SCHEMA.fields, T.StructField("fetched", T.IntegerType())])

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("fetched", T.LongType(), False),
        T.StructField("stored", T.LongType(), False),
        T.StructField("skipped_dedup", T.LongType(), False),
        T.StructField("skipped_low_confidence", T.LongType(), False),
        T.StructField("error_count", T.LongType(), False),
        T.StructField("written_at", T.TimestampType(), False),
    ]
)

RUN_ERROR_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("error", T.StringType(), False),
    ]
)

MIN_CONFIDENCE = 0.6
MAX_PAGES = 3
EMBEDDING_DIMS = 384

# Source names and their mode.
SOURCE_MODES = [
    ("cutshort", "safe"),
    ("foundit", "safe"),
    ("foundit_demo", "portfolio-demo"),
    ("greenhouse_playwright", "browser-automation-demo"),
    ("forage_ai", "html-sitemap"),
    ("greenhouse", "public-ats-api"),
    ("lever", "public-ats-api"),
    ("ashby", "public-ats-api"),
    ("himalayas", "public-job-api"),
    ("arbeitnow", "public-job-api"),
]

_INPUT_OF_SOURCE = {
    "cutshort": "job pages found through a sitemap",
    "foundit": "job pages found through a sitemap",
    "foundit_demo": "search results joined to their job pages",
    "greenhouse_playwright": "rendered board and job pages",
    "forage_ai": "job pages found through a sitemap, newest first",
    "greenhouse": "JSON feed of each board",
    "lever": "JSON feed of each company",
    "ashby": "JSON feed of each board",
    "himalayas": "paged JSON feed",
    "arbeitnow": "paged JSON feed",
}


def source_catalog(spark: SparkSession) -> DataFrame:
    """The ten catalogued sources, in catalog order."""
    rows = [
        (position, name, mode, _INPUT_OF_SOURCE[name])
        for position, (name, mode) in enumerate(SOURCE_MODES)
    ]
    return spark.createDataFrame(rows, "position int, name string, mode string, description string")
