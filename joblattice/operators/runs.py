"""Run log rows: counters per run, errors, and the latest version of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_counters(events: DataFrame, outcome: Column) -> DataFrame:
    """Counters per run and source from one row per outcome.

    ``outcome`` is fetched, stored, skipped_dedup, skipped_low_confidence or error. The
    error texts stay rows of their own (``run_errors``), since a run may have any number.
    """

    def number_of(name: str) -> Column:
        return F.count_if(outcome == name)

    return events.groupBy("run_id", "source").agg(
        number_of("fetched").alias("fetched"),
        number_of("stored").alias("stored"),
        number_of("skipped_dedup").alias("skipped_dedup"),
        number_of("skipped_low_confidence").alias("skipped_low_confidence"),
        number_of("error").alias("error_count"),
    )


def run_errors(events: DataFrame, outcome: Column, message: Column) -> DataFrame:
    return events.filter(outcome == "error").select("run_id", "source", message.alias("error"))


def runs_with_errors(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Every run row beside each of its error texts; a run without errors has one row.

    A run may have any number of errors, so they are rows and never one list.
    """
    return runs.join(errors.select("run_id", "source", "error"), ["run_id", "source"], "left")


def latest_run(
    runs: DataFrame, keys: Sequence[str] = ("run_id",), written_at: str = "written_at"
) -> DataFrame:
    """The row written last per key; the rank filter prunes older ones before the shuffle.

    With the default key a run over several sources keeps only the source logged last.
    Jobs log and read with ``("run_id", "source")``.
    """
    order = [F.desc(written_at)] + [F.desc(c) for c in ("source",) if c not in keys]
    window = Window.partitionBy(*keys).orderBy(*order)
    return runs.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
