"""The dashboard's reads over the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from joblattice.operators import stats as s
from joblattice.operators import views as v
from joblattice.schema import source_catalog
from joblattice.sources.store import read_listings, read_runs


@dataclass
class Dashboard:
    stats: DataFrame
    last_runs: DataFrame
    recent: DataFrame
    metrics: DataFrame
    skills: DataFrame
    coverage: DataFrame


def dashboard(spark: SparkSession, root: str, recent: int = v.RECENT_DEFAULT) -> Dashboard:
    listings, runs = read_listings(spark, root), v.last_runs(read_runs(spark, root))
    return Dashboard(
        stats=s.stats(listings, runs),
        last_runs=runs,
        recent=v.recent_listings(listings, v.clamp_recent(recent)),
        metrics=s.market_metrics(listings, runs),
        skills=s.skill_share(s.top_skills(listings)),
        coverage=s.source_coverage(source_catalog(spark), listings),
    )
