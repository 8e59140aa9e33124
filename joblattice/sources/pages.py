"""Captured job pages to raw listing rows.

JSON-LD is read inside the JVM. The HTML itself goes to the Python parser only for pages
whose JSON-LD leaves a gap. Fields are extracted before anything is joined, so page
bodies are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions import jsonld
from joblattice.functions.html import clean_html_text, page_fields
from joblattice.functions.text import collapse_ws, matches_role, non_empty, strip_ws, text_or_empty
from joblattice.operators.dedup import ROWS_PER_SLICE, first_arrival, sliced
from joblattice.schema import RAW_COLUMNS
from joblattice.sources.feeds import captured

# The shortest description taken from a page, and the longest body text.
MIN_PAGE_CHARS = 100
MAX_BODY_CHARS = 4000


def with_posting(pages: DataFrame) -> DataFrame:
    """Add the JSON-LD blocks and the fields of the first JobPosting, empty where absent."""
    blocks = pages.withColumn("blocks", jsonld.json_ld_blocks(jsonld.json_ld_scripts(F.col("body"))))
    posting = blocks.withColumn("posting", jsonld.job_posting(F.col("blocks")))

    def part(path: str) -> Column:
        return F.try_variant_get("posting", path, "variant")

    return posting.withColumns(
        {
            "ld_title": text_or_empty(jsonld.field(F.col("posting"), "$.title")),
            "ld_html": text_or_empty(jsonld.field(F.col("posting"), "$.description")),
            "ld_company": jsonld.extract_company(part("$.hiringOrganization")),
            "ld_location": jsonld.extract_location(part("$.jobLocation")),
            "ld_date": jsonld.field(F.col("posting"), "$.datePosted"),
        }
    ).drop("posting")


def _cleaned(pages: DataFrame) -> DataFrame:
    return pages.withColumn("ld_description", clean_html_text(F.col("ld_html"))).drop("ld_html")


def with_fields(pages: DataFrame, needed: Column) -> DataFrame:
    """Add the parsed page fields for the pages that need them, then drop the body."""
    return pages.withColumn("page", page_fields(F.when(needed, F.col("body")))).drop("body")


def selected(*names: str) -> Column:
    """Text of the first selector that found a node, white space collapsed."""
    found = F.coalesce(*[F.col(f"page.{name}") for name in names])
    return text_or_empty(collapse_ws(found))


def _empty(*names: str) -> Column:
    found = F.col(names[0]) == ""
    for name in names[1:]:
        found = found | (F.col(name) == "")
    return found


def _or(first: Column, *others: Column) -> Column:
    return F.coalesce(non_empty(first, *others), F.lit(""))


def _raw(pages: DataFrame, fetched: Column, matched: Column, **columns: Column) -> DataFrame:
    """Project to the raw columns; only rows that count as fetched or matched stay."""
    rows = pages.select(
        "source", "url", "seq", F.lit(0).alias("pos"),
        *[value.alias(name) for name, value in columns.items()],
    )
    flagged = rows.withColumn("matched", matched).withColumn("fetched", fetched)
    return flagged.filter((F.col("fetched") > 0) | F.col("matched")).select(*RAW_COLUMNS)


def page_cutshort(captures: DataFrame, role: str) -> DataFrame:
    """Every page counts as fetched, before the role test."""
    pages = _cleaned(with_posting(captured(captures, "cutshort", "page")))
    pages = with_fields(pages, _empty("ld_title", "ld_company"))
    heading = F.rtrim(strip_ws(text_or_empty(F.col("page.h1"))), F.lit(","))
    employer = strip_ws(F.replace(text_or_empty(F.col("page.h2")), F.lit("at "), F.lit("")))
    return _raw(
        pages,
        fetched=F.lit(1),
        matched=matches_role(F.col("title"), role),
        title=_or(F.col("ld_title"), heading),
        company=_or(F.col("ld_company"), employer),
        description=F.col("ld_description"),
        location=_or(F.col("ld_location"), F.lit("India")),
        posted_at=F.col("ld_date"),
    )


def page_foundit(captures: DataFrame, role: str) -> DataFrame:
    pages = _cleaned(with_posting(captured(captures, "foundit", "page")))
    pages = with_fields(pages, _empty("ld_title", "ld_company", "ld_location"))
    return _raw(
        pages,
        fetched=F.col("matched").cast("int"),
        matched=matches_role(F.col("title"), role),
        title=_or(F.col("ld_title"), strip_ws(text_or_empty(F.col("page.h1")))),
        company=_or(F.col("ld_company"), selected("company_name", "h2")),
        description=F.col("ld_description"),
        location=_or(F.col("ld_location"), selected("job_location"), F.lit("India")),
        posted_at=F.col("ld_date"),
    )


def attach_search_record(
    pages: DataFrame, records: DataFrame, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Left join of extracted pages with the first search record that led to each.

    Records are unique per page before the join, the page side holds extracted fields
    only, and a page captured very often is cut into slices.
    """
    first = first_arrival(records, keys=("source", "url"))
    named = first.select(
        "source",
        "url",
        *[
            F.col(name).alias(f"found_{name}")
            for name in ("title", "company", "location", "posted_at", "description")
        ],
    )
    left, right = sliced(pages, named, ("source", "url"), ("seq",), rows_per_slice)
    return left.join(right, ["source", "url", "_slice"], "left").drop("_slice")


def foundit_demo_fields(captures: DataFrame) -> DataFrame:
    """What a page says itself, before its search record is joined."""
    pages = _cleaned(with_posting(captured(captures, "foundit_demo", "page")))
    return pages.select("source", "url", "seq", "ld_title", "ld_company", "ld_description", "ld_location", "ld_date")


def foundit_demo_rows(pages: DataFrame, role: str) -> DataFrame:
    """Search results already counted as fetched, so the pages do not."""
    return _raw(
        pages,
        fetched=F.lit(0),
        matched=matches_role(F.col("title"), role),
        title=_or(F.col("ld_title"), F.col("found_title")),
        company=_or(F.col("ld_company"), F.col("found_company")),
        description=_or(F.col("ld_description"), F.col("found_description")),
        location=_or(F.col("ld_location"), F.col("found_location"), F.lit("India")),
        posted_at=non_empty(F.col("ld_date"), F.col("found_posted_at")),
    )


def page_foundit_demo(captures: DataFrame, records: DataFrame, role: str) -> DataFrame:
    return foundit_demo_rows(attach_search_record(foundit_demo_fields(captures), records), role)


def page_forage_ai(captures: DataFrame, role: str) -> DataFrame:
    pages = _cleaned(with_posting(captured(captures, "forage_ai", "page")))
    pages = with_fields(pages, _empty("ld_title", "ld_description", "ld_location"))
    long_enough = F.length("description") >= MIN_PAGE_CHARS
    return _raw(
        pages,
        fetched=F.col("matched").cast("int"),
        matched=long_enough & matches_role(F.col("title"), role),
        title=_or(F.col("ld_title"), selected("main_h1", "article_h1", "h1")),
        company=_or(F.col("ld_company"), F.lit("Forage AI")),
        description=_or(
            F.col("ld_description"), F.col("page.wrapper_text"), F.col("page.prose_text")
        ),
        location=_or(
            F.col("ld_location"), selected("any_location", "any_remote"), F.lit("Remote")
        ),
        posted_at=non_empty(F.col("ld_date"), jsonld.webpage_date(F.col("blocks"))),
    )


def page_greenhouse_rendered(captures: DataFrame, role: str) -> DataFrame:
    pages = _cleaned(with_posting(captured(captures, "greenhouse_playwright", "page")))
    pages = with_fields(pages, _empty("ld_title", "ld_description", "ld_location"))
    return _raw(
        pages,
        fetched=F.col("matched").cast("int"),
        matched=matches_role(F.col("title"), role),
        title=_or(F.col("ld_title"), selected("h1", "job__title")),
        company=F.col("ld_company"),
        description=_or(F.col("ld_description"), F.col("page.content_text")),
        location=_or(
            F.col("ld_location"), selected("location", "job__location"), F.lit("Remote")
        ),
        posted_at=F.col("ld_date"),
    )


def indeed_fields(captures: DataFrame) -> DataFrame:
    pages = with_fields(captured(captures, "indeed", "page"), F.lit(True))
    return pages.select("source", "url", "seq", F.col("page.job_text").alias("text"))


def indeed_rows(pages: DataFrame, role: str | None = None) -> DataFrame:
    """Card data plus the description text; no role test, counted as fetched per card."""
    return _raw(
        pages,
        fetched=F.lit(0),
        matched=F.lit(True),
        title=text_or_empty(F.col("found_title")),
        company=text_or_empty(F.col("found_company")),
        description=F.col("text"),
        location=text_or_empty(F.col("found_location")),
        posted_at=F.col("found_posted_at"),
    )


def page_indeed(captures: DataFrame, records: DataFrame) -> DataFrame:
    return indeed_rows(attach_search_record(indeed_fields(captures), records))


def ddg_fields(captures: DataFrame, max_chars: int | None = MAX_BODY_CHARS) -> DataFrame:
    """Title and body text, of which ``max_chars`` characters are kept (all if None)."""
    pages = with_fields(captured(captures, "ddg", "page"), F.lit(True))
    text = F.col("page.body_text")
    return pages.select(
        "source",
        "url",
        "seq",
        (text if max_chars is None else F.substring(text, 1, max_chars)).alias("text"),
        strip_ws(text_or_empty(F.col("page.title"))).alias("page_title"),
    )


def ddg_rows(pages: DataFrame, role: str | None = None) -> DataFrame:
    """Search title or page title, host as company, the body text."""
    return _raw(
        pages,
        fetched=F.lit(0),
        matched=F.lit(True),
        title=_or(F.col("found_title"), F.col("page_title")),
        company=text_or_empty(F.get(F.split("url", "/"), F.lit(2))),
        description=F.col("text"),
        location=F.lit("Unknown"),
        posted_at=F.lit(None).cast("string"),
    )


def page_ddg(captures: DataFrame, records: DataFrame, max_chars: int | None = MAX_BODY_CHARS) -> DataFrame:
    return ddg_rows(attach_search_record(ddg_fields(captures, max_chars), records))
