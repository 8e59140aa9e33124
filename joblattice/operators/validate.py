"""Row checks and normalisation ahead of enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.text import collapse_ws, is_blank, listing_id, non_empty, text_or_empty
from joblattice.schema import MIN_CONFIDENCE

REQUIRED = ("title", "company", "description")


def reject_reason() -> Column:
    """First required field that is blank; null for a complete row."""
    reason = F.when(is_blank(F.col(REQUIRED[0])), F.lit(REQUIRED[0]))
    for name in REQUIRED[1:]:
        reason = reason.when(is_blank(F.col(name)), F.lit(name))
    return reason


def required_fields(rows: DataFrame) -> DataFrame:
    return rows.filter(reject_reason().isNull())


def normalized_location(location: Column) -> Column:
    return F.coalesce(non_empty(collapse_ws(location)), F.lit("Unknown"))


def with_identity(rows: DataFrame) -> DataFrame:
    """Normalise the location and derive the id; a missing url counts as empty."""
    return rows.withColumns(
        {
            "location": normalized_location(F.col("location")),
            "url": text_or_empty(F.col("url")),
            "id": listing_id(F.col("source"), F.col("url")),
        }
    )


def confidence_filter(rows: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return rows.filter(F.col("confidence") >= min_confidence)
