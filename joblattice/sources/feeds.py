"""JSON feeds to raw listing rows: parse with a schema, explode, filter by role, project.

Everything but entity decoding and URL joining is JVM work on one row per job; nothing is
shuffled. A body that is no JSON gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.html import absolute_url, clean_html_text
from joblattice.functions.once import computed_once
from joblattice.functions.text import (
    board_title, epoch_to_iso, matches_role, non_empty, slugify_title, text_or_empty, truthy,
)
from joblattice.schema import RAW_COLUMNS, SEARCH_RECORD_COLUMNS


def captured(captures: DataFrame, source: str, kind: str) -> DataFrame:
    return captures.filter((F.col("source") == source) & (F.col("kind") == kind))


def _jobs(captures: DataFrame, source: str, job: str, path: str, role: str, title: str) -> DataFrame:
    """One row per feed entry whose title matches the role.

    ``path`` leads to the list inside the payload; empty means the payload is the list.
    """
    schema = f"array<struct<{job}>>"
    for step in reversed(path.split(".") if path else []):
        schema = f"struct<{step}: {schema}>"
    entries = F.from_json("body", schema)
    for step in path.split(".") if path else []:
        entries = entries[step]
    parsed = computed_once(captured(captures, source, "feed"), entries=entries)
    jobs = parsed.select("source", "board", "url", "seq", F.posexplode("entries").alias("pos", "job"))
    return jobs.filter(matches_role(F.col(f"job.{title}"), role))


def _raw(jobs: DataFrame, **columns: Column) -> DataFrame:
    """Project to the raw listing columns; every feed row counts as fetched."""
    return jobs.select(
        "source", "seq", "pos", *[value.alias(name) for name, value in columns.items()]
    ).withColumns({"fetched": F.lit(1), "matched": F.lit(True)}).select(*RAW_COLUMNS)


def feed_arbeitnow(captures: DataFrame, role: str) -> DataFrame:
    job = "title string, description string, company_name string, url string, location string, remote string, created_at string"
    jobs = _jobs(captures, "arbeitnow", job, "data", role, "title")
    elsewhere = F.when(truthy(F.col("job.remote")), F.lit("Remote")).otherwise(F.lit("Unknown"))
    return _raw(
        jobs,
        title=F.col("job.title"),
        company=text_or_empty(F.col("job.company_name")),
        url=text_or_empty(F.col("job.url")),
        description=clean_html_text(F.col("job.description")),
        location=F.coalesce(non_empty(F.col("job.location")), elsewhere),
        posted_at=epoch_to_iso(F.col("job.created_at")),
    )


def feed_ashby(captures: DataFrame, role: str) -> DataFrame:
    job = "title string, descriptionHtml string, descriptionPlain string, jobUrl string, applyUrl string, location string, isRemote string, publishedAt string"
    jobs = _jobs(captures, "ashby", job, "jobs", role, "title")
    place = text_or_empty(F.col("job.location"))
    add_remote = truthy(F.col("job.isRemote")) & ~F.lower(place).contains("remote")
    with_remote = F.when(
        add_remote, F.btrim(F.concat(place, F.lit(", Remote")), F.lit(", "))
    ).otherwise(place)
    return _raw(
        jobs,
        title=F.col("job.title"),
        company=board_title(F.col("board")),
        url=text_or_empty(non_empty(F.col("job.jobUrl"), F.col("job.applyUrl"))),
        description=clean_html_text(
            non_empty(F.col("job.descriptionHtml"), F.col("job.descriptionPlain"))
        ),
        location=F.coalesce(non_empty(with_remote), F.lit("Unknown")),
        posted_at=F.col("job.publishedAt"),
    )


def feed_greenhouse(captures: DataFrame, role: str) -> DataFrame:
    job = "title string, content string, company_name string, absolute_url string, location struct<name: string>, first_published string, updated_at string"
    jobs = _jobs(captures, "greenhouse", job, "jobs", role, "title")
    return _raw(
        jobs,
        title=F.col("job.title"),
        company=F.coalesce(non_empty(F.col("job.company_name")), board_title(F.col("board"))),
        url=text_or_empty(F.col("job.absolute_url")),
        description=clean_html_text(F.col("job.content")),
        location=F.coalesce(F.col("job.location.name"), F.lit("Unknown")),
        posted_at=non_empty(F.col("job.first_published"), F.col("job.updated_at")),
    )


def feed_himalayas(captures: DataFrame, role: str) -> DataFrame:
    job = "title string, description string, companyName string, applicationLink string, guid string, locationRestrictions array<string>, pubDate string"
    jobs = _jobs(captures, "himalayas", job, "jobs", role, "title")
    places = F.array_join("job.locationRestrictions", ", ")
    return _raw(
        jobs,
        title=F.col("job.title"),
        company=text_or_empty(F.col("job.companyName")),
        url=text_or_empty(non_empty(F.col("job.applicationLink"), F.col("job.guid"))),
        description=clean_html_text(F.col("job.description")),
        location=F.coalesce(non_empty(places), F.lit("Remote")),
        posted_at=epoch_to_iso(F.col("job.pubDate")),
    )


def feed_lever(captures: DataFrame, role: str) -> DataFrame:
    job = "text string, openingPlain string, descriptionPlain string, lists array<struct<content: string>>, additionalPlain string, categories struct<location: string>, hostedUrl string, createdAt string"
    jobs = _jobs(captures, "lever", job, "", role, "text")
    listed = F.array_join(F.transform("job.lists", lambda item: text_or_empty(item["content"])), " ")
    empty = F.lit("")
    sections = F.concat_ws(
        " ",
        F.nullif(F.col("job.openingPlain"), empty),
        F.nullif(F.col("job.descriptionPlain"), empty),
        F.nullif(listed, empty),
        F.nullif(F.col("job.additionalPlain"), empty),
    )
    return _raw(
        jobs,
        title=F.col("job.text"),
        company=board_title(F.col("board")),
        url=text_or_empty(F.col("job.hostedUrl")),
        description=clean_html_text(sections),
        location=F.coalesce(F.col("job.categories.location"), F.lit("Unknown")),
        posted_at=epoch_to_iso(F.col("job.createdAt")),
    )


def feed_foundit_search(captures: DataFrame, role: str) -> DataFrame:
    """Search results to search records; each counts as fetched here, not on its page."""
    job = "type string, title string, jobDescription string, summary string, seoJdUrl string, id string, companyName string, locations string, updatedAt string, postedAt string"
    jobs = _jobs(captures, "foundit_demo", job, "jobSearchResponse.data", role, "title")
    jobs = jobs.filter(~truthy(F.col("job.type")))
    by_slug = F.concat(
        F.lit("https://www.foundit.in/job/"),
        slugify_title(F.col("job.title")),
        F.lit("-"),
        F.coalesce("job.id", F.lit("None")),
    )
    seo_url = absolute_url(F.col("url"), non_empty(F.col("job.seoJdUrl")))
    return jobs.select(
        "source",
        F.coalesce(seo_url, by_slug).alias("url"),
        F.col("job.title").alias("title"),
        text_or_empty(F.col("job.companyName")).alias("company"),
        text_or_empty(F.col("job.locations")).alias("location"),
        non_empty(F.col("job.updatedAt"), F.col("job.postedAt")).alias("posted_at"),
        text_or_empty(non_empty(F.col("job.jobDescription"), F.col("job.summary"))).alias("description"),
        "seq",
        "pos",
    ).select(*SEARCH_RECORD_COLUMNS).withColumn("fetched", F.lit(1))
