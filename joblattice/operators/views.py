"""Listing and run views of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.text import age_label, non_empty, text_or_empty

RECENT_DEFAULT = 12
RECENT_MAX = 24
LAST_RUNS = 5
PREVIEW_COLUMNS = [
    "id", "title", "company", "url", "location", "source", "posted_at", "skills", "confidence",
    "ingested_at",
]


def listing_preview(listings: DataFrame) -> DataFrame:
    return listings.select(*PREVIEW_COLUMNS)


def recent_listings(listings: DataFrame, limit: int = RECENT_DEFAULT) -> DataFrame:
    """Newest listings first; equal times in id order."""
    return listing_preview(listings).orderBy(F.desc("ingested_at"), "id").limit(limit)


def clamp_recent(limit: int) -> int:
    """The limit the listing route accepts: 1 to 24."""
    return max(1, min(limit, RECENT_MAX))


def search_text() -> Column:
    words = [text_or_empty(F.col(name)) for name in ("title", "company", "location")]
    skills = F.array_join(F.coalesce("skills", F.array().cast("array<string>")), " ", "")
    with_skills = F.when(F.size("skills") > 0, F.concat(F.lit(" "), skills)).otherwise("")
    return F.lower(F.concat(F.concat_ws(" ", *words), with_skills))


def search_listings(listings: DataFrame, query: str = "", source: str = "") -> DataFrame:
    """Listings whose title, company, location or skills hold the query text."""
    needle = query.strip().lower()
    kept = listings
    if source:
        kept = kept.filter(F.col("source") == source)
    if needle:
        kept = kept.filter(search_text().contains(needle))
    return kept


def listing_card(listings: DataFrame) -> DataFrame:
    confidence = F.coalesce("confidence", F.lit(0.0))
    shown = F.array_join(F.slice(F.coalesce("skills", F.array().cast("array<string>")), 1, 4), ", ")
    return listings.select(
        "id",
        "title",
        "url",
        F.coalesce(non_empty(F.col("company")), F.lit("Unknown")).alias("company"),
        F.coalesce(non_empty(F.col("location")), F.lit("Not specified")).alias("location"),
        F.coalesce(non_empty(shown), F.lit("Not enriched")).alias("skills"),
        "source",
        F.floor(confidence * 100 + 0.5).alias("confidence_percent"),
        (confidence >= 0.75).alias("is_high"),
    )


def last_runs(runs: DataFrame, limit: int = LAST_RUNS) -> DataFrame:
    """Latest runs first; equal times in run and source order."""
    return runs.orderBy(F.desc("started_at"), "run_id", "source").limit(limit)


def run_card(runs: DataFrame, as_of: Column) -> DataFrame:
    return runs.select(
        "source",
        F.substring("run_id", 1, 8).alias("run"),
        "fetched",
        "stored",
        "skipped_low_confidence",
        age_label(F.col("started_at"), as_of).alias("age"),
    )
