"""Ingest: validate, drop known ids, enrich, filter, keep first arrivals, embed, append.

The rules, in order, and what they count:

* rows an adapter did not match, and rows with a blank required field, count nothing;
* an id the store holds counts as ``skipped_dedup``, whatever its confidence;
* a low-confidence row counts as ``skipped_low_confidence`` and never blocks a later copy
  of its id;
* of the remaining copies of an id the first arrival is stored, the others count as
  ``skipped_dedup``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.text import embedding_text
from joblattice.operators.dedup import ROWS_PER_SLICE, drop_known, first_arrival, known_ids
from joblattice.operators.embed import hash_embed
from joblattice.operators.enrich import enrich
from joblattice.operators.validate import reject_reason, with_identity
from joblattice.schema import EMBEDDING_DIMS, LISTING_COLUMNS, MIN_CONFIDENCE
from joblattice.session import delete_folder, prepare, scratch_dir
from joblattice.sources import store as tables


def with_defaults(raw: DataFrame) -> DataFrame:
    """Fill the adapter columns a caller left out."""
    defaults = {
        "posted_at": F.lit(None).cast("string"),
        "location": F.lit(None).cast("string"),
        "pos": F.lit(0),
        "fetched": F.lit(0),
        "matched": F.lit(True),
    }
    missing = {name: value for name, value in defaults.items() if name not in raw.columns}
    return raw.withColumns(missing) if missing else raw


def validated(raw: DataFrame) -> DataFrame:
    """Raw rows with id, clean location and ``complete``; all rows stay."""
    complete = F.col("matched") & reject_reason().isNull()
    rows = with_defaults(raw)
    return with_identity(rows.withColumn("complete", complete)).withColumn(
        "id", F.when(F.col("complete"), F.col("id"))
    )


def without_unused_text(rows: DataFrame) -> DataFrame:
    """Blank the texts of rows that only carry a count."""
    texts = ("title", "company", "description", "location", "url", "posted_at")
    return rows.withColumns({name: F.when(F.col("complete"), F.col(name)) for name in texts})


def tagged(enriched: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return enriched.withColumn("storable", F.col("complete") & (F.col("confidence") >= min_confidence))


def per_id_counts(rows: DataFrame) -> DataFrame:
    """Per id: fetched, copies, storable copies, errors and the first storable arrival.

    Narrow and combined before the shuffle, so neither a hot id nor a hot source gathers
    its rows in one task. Rows without an id are summed per source under a null id.
    """
    arrival = F.struct("seq", "pos", "row")
    return rows.groupBy("source", "id").agg(
        F.sum("fetched").alias("fetched"),
        F.count_if(F.col("complete")).alias("copies"),
        F.count_if(F.col("storable")).alias("storable"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.min(F.when(F.col("storable"), arrival))["row"].alias("first"),
    )


def with_known(per_id: DataFrame, known: DataFrame) -> DataFrame:
    """The ledger: per-id counts and whether the store holds the id."""
    flagged = known.select("id").withColumn("known", F.lit(True))
    return per_id.join(flagged, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def counters(ledger: DataFrame) -> DataFrame:
    """Run counters per source from the ledger of ids."""
    fresh = ~F.col("known")
    stored = F.when(fresh & (F.col("storable") > 0), 1).otherwise(0)
    return ledger.groupBy("source").agg(
        F.sum("fetched").cast("long").alias("fetched"),
        F.sum(stored).cast("long").alias("stored"),
        F.sum(F.when(fresh, F.col("storable") - stored).otherwise(F.col("copies")))
        .cast("long")
        .alias("skipped_dedup"),
        F.sum(F.when(fresh, F.col("copies") - F.col("storable")).otherwise(0))
        .cast("long")
        .alias("skipped_low_confidence"),
        F.sum(F.when(fresh, F.col("errors")).otherwise(0)).cast("long").alias("error_count"),
    )


def embedded(listings: DataFrame, embedder: Callable[[Column], Column]) -> DataFrame:
    text = embedding_text(F.col("title"), F.col("company"), F.col("description"))
    return listings.withColumn("embedding", embedder(text))


def default_embedder(dims: int = EMBEDDING_DIMS) -> Callable[[Column], Column]:
    return lambda text: hash_embed(text, dims)


def _staged(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ingest_batch(
    raw: DataFrame,
    root: str,
    run_id: str | None = None,
    batch_id: str | None = None,
    fetched: DataFrame | None = None,
    model_enricher: Callable[[DataFrame], DataFrame] | None = None,
    embedder: Callable[[Column], Column] | None = None,
    min_confidence: float = MIN_CONFIDENCE,
    started_at: Column | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    enricher: Callable[[DataFrame], DataFrame] = enrich,
) -> DataFrame:
    """Ingest the raw rows of one or more sources into the store; returns the run-log rows.

    A run may be made of several calls, for instance one per source. Each call is a batch of
    its own unless ``batch_id`` names it: a call with the id of an earlier batch is taken as
    that batch tried again and replaces it.

    ``enricher`` is the dictionary rule (``enrich`` with other skills and role words, say);
    ``model_enricher`` asks a model instead.

    ``fetched`` (source, fetched) adds counts made elsewhere, such as search results.

    The validated rows are written to the scratch folder once, enriched unless a model does it,
    and numbered. All decisions are made over a narrow ledger of ids: the numbers of the rows to
    store come out of it, and the texts of those rows alone are read again and embedded. Known ids
    are looked up in the key buckets of the batch's ids. With a model, known ids are dropped
    before it is asked, and its replies are written too, so that each text is sent once.
    """
    spark = prepare(raw.sparkSession)
    run_id = run_id or str(uuid.uuid4())
    batch_id = batch_id or f"{run_id}-{uuid.uuid4().hex}"
    started_at = F.current_timestamp() if started_at is None else started_at
    tables.ensure_tables(spark, root)
    if batch_id in tables.merged_batches(spark, root):
        raise ValueError(f"batch {batch_id} has been merged with others and can't be replaced")
    scratch = f"{scratch_dir(spark)}/ingest-{batch_id}-{uuid.uuid4().hex}"

    checked = without_unused_text(validated(raw)).withColumn("row", F.monotonically_increasing_id())
    if model_enricher is None:
        checked = tagged(enricher(checked), min_confidence)
    else:
        checked = checked.withColumns({"storable": F.lit(False), "error": F.lit(None).cast("string")})
    rows = _staged(checked, f"{scratch}/checked")
    per_id = _staged(per_id_counts(rows), f"{scratch}/per_id")
    stored = tables.read_keys(spark, root, tables.buckets_of(per_id), without_batch=batch_id)
    ledger = with_known(per_id, known_ids(per_id, stored))
    if model_enricher is not None:
        ledger = _staged(ledger, f"{scratch}/known")
        fresh = drop_known(rows.filter("complete"), ledger.filter("known"), rows_per_slice=rows_per_slice)
        rows = _staged(tagged(model_enricher(fresh), min_confidence), f"{scratch}/answered")
        answered = per_id_counts(rows).select("source", "id", *(F.col(c).alias(f"_{c}") for c in ("storable", "errors", "first")))
        ledger = ledger.join(answered, ["source", "id"], "left").withColumns({
            "storable": F.coalesce("_storable", F.lit(0)), "errors": F.coalesce("_errors", F.lit(0)), "first": F.col("_first"),
        }).drop("_storable", "_errors", "_first")
    ledger = _staged(ledger, f"{scratch}/ledger")
    chosen = ledger.filter("storable > 0 and not known").select("id", F.col("first").alias("row"))
    new = embedded(rows.join(chosen.select("row"), "row", "left_semi"), embedder or default_embedder())
    new = new.withColumn("ingested_at", F.current_timestamp()).select(*LISTING_COLUMNS)
    tables.write_listings(new, root, batch_id, chosen)

    errors = rows.filter(F.col("error").isNotNull()).select(
        F.lit(run_id).alias("run_id"), "source", "error"
    )
    counts = counters(ledger)
    if fetched is not None:
        extra = fetched.groupBy("source").agg(F.sum("fetched").alias("_more"))
        counts = (
            counts.join(extra, "source", "full")
            .withColumn("fetched", F.coalesce("fetched", F.lit(0)) + F.coalesce("_more", F.lit(0)))
            .drop("_more")
            .fillna(0)
        )
    tables.write_batch(errors, root, "run_errors", batch_id)
    tables.write_batch(run_log_rows(counts, run_id, started_at), root, "run_log", batch_id)
    delete_folder(spark, scratch)
    return tables.read_runs(spark, root).filter(F.col("run_id") == run_id)


def first_rows(rows: DataFrame, scratch: str) -> DataFrame:
    """(id, row) of the first of the numbered ``rows`` of every id, by ``ingested_at``, then ``description``.

    Ids, times and numbers alone are compared; descriptions are sent only where an id's first time has
    several rows.
    """
    at = F.unix_micros("ingested_at").alias("at")
    times = rows.select("id", at, "row").groupBy("id", "at").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"))
    first = _staged(first_arrival(times, order=("at",)), f"{scratch}/first")
    tied = first.filter("copies > 1")
    if tied.isEmpty():
        return first.select("id", "row")
    tied = tied.select(F.col("id").alias("_id"), F.col("at").alias("_at"))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("at").eqNullSafe(F.col("_at"))
    copies = rows.select("id", at, "description", "row").join(tied, same, "left_semi")
    settled = first_arrival(copies, order=("description", "row")).select("id", "row")
    return first.filter("copies = 1").select("id", "row").unionByName(settled)


def insert_if_absent(listings: DataFrame, root: str, batch_id: str | None = None) -> DataFrame:
    """Append finished listings whose id is new; returns every given id and ``inserted``.

    Of several rows of an id in one call the first by ``ingested_at`` counts. The listings are written
    to the scratch folder once and numbered; what is decided of their ids, times and numbers is a
    narrow table, and the texts move once more, to the rows that are stored.
    """
    spark = listings.sparkSession
    batch_id = batch_id or uuid.uuid4().hex
    tables.ensure_tables(spark, root)
    scratch = f"{scratch_dir(spark)}/insert-{batch_id}-{uuid.uuid4().hex}"
    numbered = listings.select(*LISTING_COLUMNS).withColumn("row", F.monotonically_increasing_id())
    rows = _staged(numbered, f"{scratch}/rows")
    given = _staged(first_rows(rows, scratch), f"{scratch}/given")
    store = tables.read_keys(spark, root, tables.buckets_of(given), without_batch=batch_id)
    chosen = _staged(given.join(known_ids(given, store).distinct(), "id", "left_anti"), f"{scratch}/chosen")
    # the build side is one number a row; the texts are not sorted
    new = rows.join(chosen.select("row").hint("shuffle_hash"), "row", "left_semi")
    tables.write_listings(new, root, batch_id, chosen)
    for name in ("rows", "first", "chosen"):
        delete_folder(spark, f"{scratch}/{name}")
    inserted = tables.read_batch_keys(spark, root, batch_id).withColumn("inserted", F.lit(True))
    return given.select("id").join(inserted, "id", "left").withColumn("inserted", F.coalesce("inserted", F.lit(False)))


def run_log_rows(counts: DataFrame, run_id: str, started_at: Column) -> DataFrame:
    """One row per source; its error texts are rows of ``run_errors``."""
    return counts.withColumns(
        {
            "run_id": F.lit(run_id),
            "started_at": started_at.cast("timestamp"),
            "written_at": F.current_timestamp(),
        }
    )
