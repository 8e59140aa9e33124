"""Counts over the listing table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_SKILLS = 10
SKILL_BARS = 8


def total_listings(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count(F.lit(1)).alias("total_listings"))


def by_source(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(F.count(F.lit(1)).alias("count"))


def _top(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), "skill").limit(k)


def top_skills(listings: DataFrame, k: int = TOP_SKILLS) -> DataFrame:
    """Most frequent skills by number of mentions; ties in skill order."""
    mentions = listings.select(F.explode("skills").alias("skill"))
    return _top(mentions.groupBy("skill").agg(F.count(F.lit(1)).alias("count")), k)


def market_counts(listings: DataFrame) -> DataFrame:
    """Listings per source and mentions per skill from one scan: kind, name, count."""
    tagged = F.concat(
        F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("name"))),
        F.transform(
            F.coalesce("skills", F.array().cast("array<string>")),
            lambda skill: F.struct(F.lit("skill").alias("kind"), skill.alias("name")),
        ),
    )
    return (
        listings.select(F.inline(tagged)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("count"))
    )


def _parts(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    counts = market_counts(listings)
    sources = counts.filter("kind = 'source'").select(F.col("name").alias("source"), "count")
    skills = counts.filter("kind = 'skill'").select(F.col("name").alias("skill"), "count")
    return sources, _top(skills, TOP_SKILLS)


def _number_of(section: str) -> Column:
    return F.when(F.col("section") == section, F.col("count"))


def _sections(listings: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Source counts, top skills and runs as rows of one narrow table."""
    sources, skills = _parts(listings)
    rows = sources.select(
        F.lit("source").alias("section"), F.col("source").alias("name"), "count"
    ).unionByName(skills.select(F.lit("skill").alias("section"), F.col("skill").alias("name"), "count"))
    if runs is not None:
        rows = rows.unionByName(
            runs.select(F.lit("run").alias("section"), F.col("run_id").alias("name"), F.lit(1).alias("count"))
        )
    return rows


def stats(listings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row: total_listings, by_source map, the ordered top_skills and last_runs.

    ``runs`` are the runs to show, in the order of ``views.last_runs``. The map holds one entry per
    source adapter, the lists ten skills and these runs; none grows with the number of listings.
    """
    rows = _sections(listings, None)
    if runs is not None:
        shown = F.struct(*runs.columns)
        rows = rows.unionByName(runs.select(
            F.lit("run").alias("section"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("count"),
            F.struct((-F.unix_micros("started_at")).alias("order"), F.col("run_id"), shown.alias("run")).alias("run")), allowMissingColumns=True)
    entry = F.struct(F.col("name"), F.col("count"))
    is_skill = F.col("section") == "skill"
    ranked = F.array_sort(
        F.collect_list(F.when(is_skill, F.struct((-F.col("count")).alias("order"), "name")))
    )
    more = [] if runs is None else [
        F.transform(F.array_sort(F.collect_list("run")), lambda r: r["run"]).alias("last_runs")]
    return rows.agg(
        F.coalesce(F.sum(_number_of("source")), F.lit(0)).alias("total_listings"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("section") == "source", entry)))
        ).alias("by_source"),
        F.transform(
            ranked, lambda s: F.struct(s["name"].alias("skill"), (-s["order"]).alias("count"))
        ).alias("top_skills"),
        *more,
    )


def market_metrics(listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Headline numbers of the dashboard, given the runs it shows."""
    is_skill = F.col("section") == "skill"
    leader = F.min(F.when(is_skill, F.struct((-F.col("count")).alias("order"), "name")))
    return _sections(listings, runs).agg(
        F.coalesce(F.sum(_number_of("source")), F.lit(0)).alias("total_listings"),
        F.count_if(F.col("section") == "source").alias("source_count"),
        F.count_if(F.col("section") == "run").alias("run_count"),
        F.coalesce(leader["name"], F.lit("No data")).alias("leading_skill"),
        (-leader["order"]).alias("leading_count"),
        F.coalesce(F.sum(_number_of("skill")), F.lit(0)).alias("total_mentions"),
    )


def skill_share(top: DataFrame, bars: int = SKILL_BARS) -> DataFrame:
    """The leading skills with bar width in percent of the largest count, at least 4.

    ``top`` is the result of ``top_skills``, at most ten rows.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("count")).alias("order"), F.col("skill")))
    )
    packed = top.agg(ordered.alias("ranked"), F.max("count").alias("largest"))
    rows = packed.select("largest", F.posexplode(F.slice("ranked", 1, bars)).alias("pos", "bar"))
    count = -F.col("bar.order")
    return rows.select(
        (F.col("pos") + 1).alias("rank"),
        F.col("bar.skill").alias("skill"),
        count.alias("count"),
        F.greatest(F.lit(4.0), count / F.greatest("largest", F.lit(1)) * 100).alias("bar_percent"),
    )


def source_coverage(catalog: DataFrame, listings: DataFrame) -> DataFrame:
    """Every catalogued source with its number of listings."""
    counts = by_source(listings).withColumnRenamed("source", "name")
    return catalog.join(counts, "name", "left").select(
        "name", "mode", F.coalesce("count", F.lit(0)).alias("count")
    )
