"""The batch ingest, run per micro-batch of a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from joblattice.plans.adapters import (
    DEFAULT_SOURCES, SEARCHED, direct_listings, known_sources, requested, searched_rows, union_sources,
)
from joblattice.plans.ingest import ingest_batch
from joblattice.session import delete_folder, scratch_dir
from joblattice.streaming.matching import CLOCK_SKEW, STATE_CONF, WAIT, matched


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the stream when its checkpoint folder was made."""
    metadata = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata")
    return metadata.first()["id"]


def ingest_stream(
    captures: DataFrame,
    adapter: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]],
    root: str,
    checkpoint: str,
    run_prefix: str = "stream",
    available_now: bool = True,
    processing_time: str = "1 minute",
    **options,
) -> StreamingQuery:
    """Start a query that ingests captured rows as they arrive.

    ``adapter`` turns a micro-batch into raw listing rows, or into a pair of them and
    fetched counts. The batch id is made of the stream's id, which Spark keeps in the
    checkpoint folder, and the micro-batch number: a micro-batch run again after a failure
    replaces what its first attempt wrote, and two streams into one store never meet.
    """

    def ingest(batch: DataFrame, number: int) -> None:
        name = f"{run_prefix}-{stream_id(batch.sparkSession, checkpoint)}-{number:010d}"
        adapted = adapter(batch)
        raw, fetched = adapted if isinstance(adapted, tuple) else (adapted, None)
        ingest_batch(raw, root, run_id=name, batch_id=name, fetched=fetched, **options)

    trigger = {"availableNow": True} if available_now else {"processingTime": processing_time}
    return (
        captures.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


@contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for a query that starts inside; a query keeps those it was started with."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def ingest_captures_stream(
    captures: DataFrame,
    role: str,
    root: str,
    checkpoint: str,
    sources: Sequence[str] = DEFAULT_SOURCES,
    run_prefix: str = "stream",
    available_now: bool = True,
    processing_time: str = "1 minute",
    wait: timedelta = WAIT,
    clock_skew: timedelta = CLOCK_SKEW,
    **options,
) -> StreamingQuery:
    """Start a query that ingests captured responses of all kinds as they arrive.

    Pages of search results meet their search record in the query's state, whichever comes
    first (``matching``). A page that has waited ``wait`` is ingested from what it says itself.
    A micro-batch is written to the scratch folder once, by source, and read by the adapters
    from there.
    """
    sources = known_sources(sources)
    searched = [source for source in sources if source in SEARCHED]
    direct = [source for source in sources if source not in SEARCHED]
    rows = captures.filter(F.col("source").isin(direct)).withColumn("part", F.lit("capture"))
    if searched:
        rows = rows.unionByName(matched(captures, role, searched, wait, clock_skew), allowMissingColumns=True)

    def ingest(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"{run_prefix}-{stream_id(spark, checkpoint)}-{number:010d}"
        scratch = f"{scratch_dir(spark)}/captured-{name}-{uuid.uuid4().hex}"
        batch.write.mode("overwrite").partitionBy("part", "source").parquet(scratch)
        staged = spark.read.schema(batch.schema).parquet(scratch)
        if not staged.isEmpty():  # else only the clock went on
            found = staged.filter("part = 'found'").groupBy("source").agg(F.sum("fetched").cast("long").alias("fetched"))
            raw = direct_listings(staged.filter("part = 'capture'").select(captures.columns), role, sources)
            raw += searched_rows(staged.filter("part = 'page'"), role, searched)
            counts = requested(spark, sources).unionByName(found)
            ingest_batch(union_sources(raw), root, run_id=name, batch_id=name, fetched=counts, **options)
        delete_folder(spark, scratch)

    trigger = {"availableNow": True} if available_now else {"processingTime": processing_time}
    with session_conf(captures.sparkSession, STATE_CONF):
        return (
            rows.writeStream.foreachBatch(ingest)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
