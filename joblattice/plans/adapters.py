"""All source adapters over one capture table, unioned to raw listing rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.schema import FOUND_SCHEMA, SOURCE_MODES
from joblattice.sources import feeds, frontier, pages

DEFAULT_SOURCES = tuple(name for name, _ in SOURCE_MODES)

# Sources read from one kind of capture alone.
DIRECT = {
    "arbeitnow": feeds.feed_arbeitnow,
    "ashby": feeds.feed_ashby,
    "greenhouse": feeds.feed_greenhouse,
    "himalayas": feeds.feed_himalayas,
    "lever": feeds.feed_lever,
    "cutshort": pages.page_cutshort,
    "foundit": pages.page_foundit,
    "forage_ai": pages.page_forage_ai,
    "greenhouse_playwright": pages.page_greenhouse_rendered,
}
# Sources whose pages need the search record that led to them.
SEARCHED = ("foundit_demo", "indeed", "ddg")
ALL_SOURCES = (*DIRECT, *SEARCHED)


def search_frontier(captures: DataFrame, source: str, role: str) -> DataFrame:
    if source == "foundit_demo":
        return feeds.feed_foundit_search(captures, role)
    if source == "indeed":
        return frontier.card_frontier(captures)
    return frontier.result_link_frontier(captures)


FIELDS = {"foundit_demo": pages.foundit_demo_fields, "indeed": pages.indeed_fields, "ddg": pages.ddg_fields}
ROWS = {"foundit_demo": pages.foundit_demo_rows, "indeed": pages.indeed_rows, "ddg": pages.ddg_rows}


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def known_sources(sources: Sequence[str]) -> list[str]:
    unknown = sorted(set(sources) - set(ALL_SOURCES))
    if unknown:
        raise ValueError(f"no such source: {', '.join(unknown)}")
    return list(sources)


def found_rows(captures: DataFrame, role: str, sources: Sequence[str]) -> DataFrame:
    """Every search result in the captures of ``sources``: a search record and its fetched count."""
    parts = []
    for source in sources:
        found = search_frontier(captures, source, role)
        columns = [
            (F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FOUND_SCHEMA
        ]
        parts.append(found.select(*columns))
    return union_sources(parts)


def searched_rows(attached: DataFrame, role: str, sources: Sequence[str]) -> list[DataFrame]:
    """Raw rows of the searched sources, of pages that have their search record."""
    return [ROWS[source](attached.filter(F.col("source") == source), role) for source in sources]


def requested(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """A fetched count of zero per source, so that one without a single row is logged."""
    return spark.createDataFrame([(name, 0) for name in sources], "source string, fetched long")


def direct_listings(captures: DataFrame, role: str, sources: Sequence[str]) -> list[DataFrame]:
    return [DIRECT[source](captures, role) for source in sources if source in DIRECT]


def raw_listings(
    captures: DataFrame,
    role: str,
    sources: Sequence[str] = DEFAULT_SOURCES,
    stage: Callable[[str, DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Raw rows of the sources, and fetched counts made outside of them.

    Every adapter filters on source and kind, so captures stored by ``store.write_captures``
    are read once over all of them. Search results are needed twice, as records of the pages
    and as counts: ``stage`` (name, rows) may write and reread them, so that they are parsed
    once.
    """
    sources = known_sources(sources)
    rows = direct_listings(captures, role, sources)
    counts = [requested(captures.sparkSession, sources)]
    searched = [source for source in sources if source in SEARCHED]
    if searched:
        found = found_rows(captures, role, searched)
        if stage is not None:
            found = stage("found", found)
        counts.append(frontier.fetched_counts(found))
        records = frontier.search_records(found)
        for source in searched:
            own = records.filter(F.col("source") == source)
            rows.append(ROWS[source](pages.attach_search_record(FIELDS[source](captures), own), role))
    return union_sources(rows), union_sources(counts)
