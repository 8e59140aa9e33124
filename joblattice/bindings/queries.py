"""Every operator as a query over the test tables.

Listings come from ``documents``: the first line is the title, the whole text the
description, the language the source. Feeds, sitemaps and pages are built from the same
rows in Spark and parsed back, so the work of each query grows with its tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.functions import jsonld, vectors
from joblattice.functions import text as t
from joblattice.functions.html import clean_html_text, page_fields
from joblattice.operators import dedup, enrich, runs, search, stats, validate, views
from joblattice.operators.embed import hash_embed
from joblattice.plans import answers, ingest
from joblattice.plans.adapters import ALL_SOURCES, raw_listings, union_sources
from joblattice.session import prepare, scratch_dir
from joblattice.sources import feeds, frontier, pages
from joblattice.sources.store import (
    compact, read_captures, read_captures_stream, read_keys, read_listings, read_run_errors, read_runs, write_captures,
)
from joblattice.streaming import matching
from joblattice.streaming.ingest import ingest_captures_stream, ingest_stream, session_conf

TERMS = ("that", "with", "this", "from", "tion")
WORDS = ("that", "with", "para", "der")
ROLE = "of the"
DIMS = 64
AS_OF = "2024-02-01 00:00:00"
TABLE_COLUMNS = {"documents": "doc_id long, text string, lang string, source string, n_chars long"}

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Use all cores where a table has fewer files than there are cores.

    The test tables are single files; a table of many files is read as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def raw_from(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("seq"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("company"),
        F.concat(F.lit("https://docs.example/"), F.md5("text")).alias("url"),
        F.col("text").alias("description"),
        F.col("lang").alias("location"),
        F.col("lang").alias("source"),
        F.lit(1).alias("fetched"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from(table(spark, sf_dir, "documents"))


def enriched_by_terms(rows: DataFrame) -> DataFrame:
    return enrich.enrich(rows, TERMS, WORDS)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_by_terms(raw_from(spread(table(spark, sf_dir, "documents"))))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored listings, one second apart."""
    rows = validate.with_identity(enriched(spark, sf_dir))
    return rows.withColumns(
        {
            "posted_at": F.lit(None).cast("string"),
            "ingested_at": F.timestamp_seconds("seq"),
        }
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of the ingest queries: the labelled documents, one row per id."""
    ids = validate.with_identity(raw(spark, sf_dir)).select("seq", "id")
    # no semi-join, which Spark would move below the ids, to the texts
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    return ids.join(labelled, "seq").select("id").distinct()


def skill_text(skills: Column | str = "skills") -> Column:
    return F.array_join(skills, ",")


# Validation, enrichment, deduplication, ingest


def normalize_text(spark, sf_dir):
    normal = t.normalize_text(F.col("text"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(normal).alias("digest"), F.length(normal).cast("long").alias("n"))


def collapse_ws(spark, sf_dir):
    clean = t.collapse_ws(F.col("text"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("n"))


def embedding_text(spark, sf_dir):
    text = t.embedding_text(F.col("title"), F.col("company"), F.col("description"))
    return raw(spark, sf_dir).select("seq", text.alias("text"))


def embedding_text_whole(spark, sf_dir):
    text = t.embedding_text(F.col("title"), F.col("company"), F.col("description"), max_chars=None)
    return raw(spark, sf_dir).select("seq", F.md5(text).alias("digest"), F.length(text).alias("n"))


def text_lines(spark, sf_dir) -> DataFrame:
    """Every line of every document: seq, pos, line."""
    lines = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("seq"), lines)


def slugify_title(spark, sf_dir):
    return text_lines(spark, sf_dir).select("seq", "pos", t.slugify_title(F.col("line")).alias("slug"))


def board_title(spark, sf_dir):
    board = F.concat_ws("-", F.lower("p_name"), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", t.board_title(board).alias("company"))


def required_fields(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("company"))
    parts = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.substring_index("text", ".", 1).alias("title"),
        F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1).alias("description"),
    )
    rows = parts.join(labels, "doc_id", "left")
    return rows.select("doc_id", validate.reject_reason().alias("reject_reason"))


def role_filter(spark, sf_dir):
    line = F.col("line")
    return text_lines(spark, sf_dir).select(
        "seq", "pos", t.matches_role(line, ROLE).alias("of_the"), t.matches_role(line, "tion ther").alias("tion_ther")
    )


def enrich_documents(spark, sf_dir):
    return enriched(spark, sf_dir).select("seq", skill_text().alias("skills"), "confidence")


def _load_stub_model():
    """Stands in for a model: fails on texts with a secret, else scores by length."""

    def reply(texts: list[str]) -> list[str]:
        if any("token =" in text for text in texts):
            raise enrich.ModelUnavailable("refused")
        return [
            json.dumps({"skills": [f" size {len(text) // 1000} ", ""], "confidence": min(len(text), 1000) / 1000})
            for text in texts
        ]

    return reply


def enrich_with_model(spark, sf_dir):
    rows = raw_from(spread(table(spark, sf_dir, "documents")))
    scored = enrich.enrich_with(rows, _load_stub_model, skills=TERMS, role_words=WORDS)
    return scored.select("seq", skill_text().alias("skills"), "confidence")


def _load_stub_answers():
    def reply(pairs: list[tuple[str, str]]) -> list[str]:
        return [f" {question}: {len(context)} " for question, context in pairs]

    return reply


def answer_with_model(spark, sf_dir):
    found = _retrieved(spark, sf_dir)
    answer = answers.answer_with(F.col("question_id").cast("string"), F.col("context"), _load_stub_answers)
    return found.select("question_id", answer.alias("answer"))


def confidence_kept(spark, sf_dir):
    kept = validate.confidence_filter(enriched(spark, sf_dir))
    return kept.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def listing_ids_first(spark, sf_dir):
    rows = validate.with_identity(raw(spark, sf_dir).withColumn("source", F.lit("docs")))
    return dedup.first_arrival(rows.select("id", "url", "seq"), order=("seq",))


def drop_known(spark, sf_dir):
    rows = validate.with_identity(raw(spark, sf_dir)).select("id", "seq")
    return dedup.drop_known(rows, stored(spark, sf_dir), order=("seq",))


INGEST = {"enricher": enriched_by_terms, "embedder": ingest.default_embedder(DIMS), "min_confidence": 0.6}


def _fresh_root(spark, name: str) -> str:
    return f"{scratch_dir(prepare(spark))}/{name}-{uuid.uuid4().hex}"


def _seeded_root(spark, sf_dir) -> str:
    """A fresh store with the labelled documents."""
    root = _fresh_root(spark, "store")
    rows = listings(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    ingest.insert_if_absent(rows.join(stored(spark, sf_dir), "id", "left_semi"), root)
    return root


def ingest_outcomes(spark, sf_dir):
    """Counters of a batch into a store that holds the labelled documents."""
    root = _seeded_root(spark, sf_dir)
    rows = raw_from(spread(table(spark, sf_dir, "documents")))
    log = ingest.ingest_batch(rows, root, "run", **INGEST)
    return log.drop("run_id", "started_at", "written_at", "error_count")


def ingest_new_listings(spark, sf_dir):
    """What that batch stored; ``posted_at`` tells which of the copies it was."""
    root = _seeded_root(spark, sf_dir)
    rows = raw_from(spread(table(spark, sf_dir, "documents"))).withColumn("posted_at", F.col("seq").cast("string"))
    ingest.ingest_batch(rows, root, "run", **INGEST)
    new = read_listings(spark, root).filter("posted_at is not null")
    return new.select(
        "id", F.col("posted_at").cast("long").alias("seq"), "source", "url", "location", "confidence", skill_text().alias("skills"))


def ingest_batch_store(spark, sf_dir):
    """The batch job into a fresh store, read back."""
    root = _fresh_root(spark, "store")
    ingest.ingest_batch(raw_from(spread(table(spark, sf_dir, "documents"))), root, "run", **INGEST)
    return _store_view(spark, root)


def _stream(spark, sf_dir, adapter, store, checkpoint):
    documents = spark.readStream.schema(TABLE_COLUMNS["documents"]).parquet(f"{sf_dir}/documents*.parquet")
    ingest_stream(documents, adapter, store, checkpoint, **INGEST).awaitTermination()


def ingest_stream_store(spark, sf_dir):
    """The streaming job over the documents file into a fresh store, read back."""
    base = _fresh_root(spark, "stream")
    _stream(spark, sf_dir, raw_from, f"{base}/store", f"{base}/checkpoint")
    return _store_view(spark, f"{base}/store")


def ingest_two_streams(spark, sf_dir):
    """Two streams with checkpoints of their own into one store: the listings of both stay."""
    base = _fresh_root(spark, "streams")
    for name, condition in (("first", "lang = 'en'"), ("second", "lang <> 'en'")):
        _stream(spark, sf_dir, lambda batch, c=condition: raw_from(batch.filter(c)), f"{base}/store", f"{base}/{name}")
    return _store_view(spark, f"{base}/store")


def ingest_per_source(spark, sf_dir):
    """One run, ingested source by source: log row and stored listings of every source."""
    root = _fresh_root(spark, "store")
    rows = raw_from(table(spark, sf_dir, "documents"))
    for (source,) in rows.select("source").distinct().collect():  # a name for each source
        ingest.ingest_batch(rows.filter(F.col("source").eqNullSafe(F.lit(source))), root, "run", **INGEST)
    held = read_listings(spark, root).groupBy("source").agg(F.count(F.lit(1)).alias("listings"))
    log = read_runs(spark, root).drop("started_at", "written_at", "error_count")
    return log.join(held, "source", "left").withColumn("listings", F.coalesce("listings", F.lit(0)))


def ingest_errors(spark, sf_dir):
    """All error rows of a run whose model refuses texts, read beside their run row."""
    root = _fresh_root(spark, "store")
    rows = raw_from(spread(table(spark, sf_dir, "documents"))).withColumn("url", F.concat_ws("#", "url", "seq"))
    ingest.ingest_batch(
        rows, root, "run", embedder=ingest.default_embedder(DIMS),
        model_enricher=lambda r: enrich.enrich_with(r, _load_failing_model))
    found = runs.runs_with_errors(read_runs(spark, root), read_run_errors(spark, root))
    return found.select("run_id", "source", "stored", "error_count", "error")


def _load_failing_model():
    def reply(texts: list[str]) -> list[str]:
        if any(len(text) % 2 for text in texts):
            raise RuntimeError("odd length")
        return [json.dumps({"skills": ["even"], "confidence": 0.9}) for _ in texts]

    return reply


def insert_if_absent(spark, sf_dir):
    """Finished listings inserted where the id is new, after those of the labelled documents."""
    root = _fresh_root(spark, "store")
    rows = listings(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    known = stored(spark, sf_dir)
    ingest.insert_if_absent(rows.join(known, "id", "left_semi"), root)
    return ingest.insert_if_absent(rows, root)


def _weights(vector: str) -> Column:
    """A vector as text, in millionths."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ",")


def _store_view(spark, root):
    kept = read_listings(spark, root).filter(F.size("embedding") == DIMS)
    return kept.select(
        "id", "source", "url", F.md5("description").alias("digest"), skill_text().alias("skills"), "confidence", "location",
        F.md5(_weights("embedding")).alias("vector"))


def ingest_compacted(spark, sf_dir):
    """One run in eight batches, after the sixth the older ones merged; the log and all listings stay."""
    root = _fresh_root(spark, "store")
    rows = raw_from(table(spark, sf_dir, "documents"))
    for number in range(8):
        part = rows.filter(F.pmod("seq", F.lit(8)) == number)
        ingest.ingest_batch(part, root, "run", batch_id=f"part{number}", **INGEST)
        if number == 5:
            compact(spark, root, keep=1)
    found = read_listings(spark, root).groupBy("source").agg(
        F.count(F.lit(1)).alias("listings"), F.countDistinct("id").alias("ids"), F.sum(F.size("skills")).alias("skills"))
    keys = read_keys(spark, root).distinct().count()
    return found.withColumn("all_keys", F.lit(keys).cast("long"))


def _captured_pages(spark, sf_dir, groups: list[int], kind: str) -> DataFrame:
    """Pages of some of four groups as captures: the page itself, or a search result that leads to it."""
    rows = _pages(spark, sf_dir).filter(F.pmod("page_id", F.lit(4)).isin(groups))
    if kind == "page":
        body = F.replace("html", F.lit("<article>"), F.lit('<article id="jobDescriptionText">'))
        url = F.col("url")
    else:
        body = _card(F.col("url"), F.concat(F.lit("Found of the "), F.col("page_id").cast("string")), F.lit("Finder"), F.lit("Pune"))
        url = F.lit("https://in.indeed.com/jobs?q=x")
    return rows.select(
        F.lit("indeed").alias("source"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("board"), url.alias("url"),
        body.alias("body"), F.lit(0).alias("page"), F.col("page_id").alias("seq"), F.lit(None).cast("timestamp").alias("fetched_at"))


def _card(url: Column, title: Column, company: Column, location: Column) -> Column:
    """A result card."""
    def escaped(text: Column) -> Column:
        return F.replace(text, F.lit("&"), F.lit("&amp;"))

    return F.concat(
        F.lit('<div class="job_seen_beacon"><h2><a href="'), escaped(url), F.lit('"><span> '), escaped(title),
        F.lit("</span></a></h2><span class=companyName>"), company, F.lit('</span><div class="companyLocation">'), location, F.lit("</div></div>"))


def ingest_captures(spark, sf_dir):
    """Three runs of a capture stream. A page's search record comes before it, with it, after it or never."""
    base = _fresh_root(spark, "captures")
    feed = _lever_captures(spark, sf_dir).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    steps = [
        [_captured_pages(spark, sf_dir, [0], "search"), _captured_pages(spark, sf_dir, [3], "page"), feed],
        [_captured_pages(spark, sf_dir, [0, 1, 2], "page"), _captured_pages(spark, sf_dir, [1], "search")],
        [_captured_pages(spark, sf_dir, [2], "search")],
    ]
    options = {
        "enricher": lambda rows: enrich.enrich(rows, TERMS, WORDS), "embedder": ingest.default_embedder(8), "min_confidence": 0.0,
        "wait": timedelta(0), "clock_skew": timedelta(milliseconds=1)}
    for step in steps:
        write_captures(union_sources(step), f"{base}/captures")
        stream = read_captures_stream(spark, f"{base}/captures")
        ingest_captures_stream(stream, ROLE, f"{base}/store", f"{base}/checkpoint", ["indeed", "lever"], **options).awaitTermination()
    log = read_runs(spark, f"{base}/store").groupBy("source").agg(
        F.sum("fetched").alias("fetched"), F.sum("stored").alias("stored"), F.sum("skipped_dedup").alias("skipped_dedup"))
    held = read_listings(spark, f"{base}/store").groupBy("source").agg(
        F.count(F.lit(1)).alias("listings"), F.count_if(F.col("title").startswith("Found of the ")).alias("found_titles"),
        F.count_if(F.col("company") == "Finder").alias("found_companies"), F.sum(F.length("description")).alias("chars"))
    return log.join(held, "source", "left")


def ingest_captures_pages(spark, sf_dir):
    """The raw rows of such a stream: every page and what it got from its search record."""
    base = _fresh_root(spark, "captures")
    steps = [
        [_captured_pages(spark, sf_dir, [0], "search"), _captured_pages(spark, sf_dir, [3], "page")],
        [_captured_pages(spark, sf_dir, [0, 1, 2], "page"), _captured_pages(spark, sf_dir, [1], "search")],
        [_captured_pages(spark, sf_dir, [2], "search")],
    ]
    for step in steps:
        write_captures(union_sources(step), f"{base}/captures")
        rows = matching.matched(
            read_captures_stream(spark, f"{base}/captures"), ROLE, ["indeed"], timedelta(0), timedelta(milliseconds=1))
        with session_conf(spark, matching.STATE_CONF):
            rows.writeStream.format("parquet").option("path", f"{base}/rows").option(
                "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(matching.MATCHED).parquet(f"{base}/rows")
    return found.filter("part = 'page'").select(
        "url", "seq", F.md5("text").alias("digest"), F.coalesce("found_title", F.lit("-")).alias("title"),
        F.coalesce("found_company", F.lit("-")).alias("company"))


def ingest_run_log(spark, sf_dir):
    root = _fresh_root(spark, "store")
    for run in ("run1", "run2"):
        ingest.ingest_batch(raw_from(spread(table(spark, sf_dir, "documents"))), root, run, **INGEST)
    return read_runs(spark, root).drop("started_at", "written_at", "error_count")


# Counts and views


def total_listings(spark, sf_dir):
    return stats.total_listings(raw(spark, sf_dir))


def by_source(spark, sf_dir):
    return stats.by_source(raw(spark, sf_dir))


def top_skills(spark, sf_dir):
    return stats.top_skills(enriched(spark, sf_dir))


def stats_bundle(spark, sf_dir):
    def listed(pairs: Column, name: str) -> Column:
        return F.array_join(F.transform(pairs, lambda p: F.concat(p[name], F.lit("="), p[_other(name)])), ",")

    def _other(name: str) -> str:
        return {"key": "value", "skill": "count"}[name]

    shown = views.last_runs(_logged_runs(spark, sf_dir))
    return stats.stats(enriched(spark, sf_dir), shown).select(
        "total_listings",
        listed(F.array_sort(F.map_entries("by_source")), "key").alias("by_source"),
        listed(F.col("top_skills"), "skill").alias("top_skills"),
        F.array_join(F.transform("last_runs", lambda r: F.concat_ws(
            "/", r["run_id"], r["source"], r["fetched"], r["stored"], r["skipped_dedup"], r["skipped_low_confidence"], r["error_count"])), ",").alias("last_runs"),
    )


def source_coverage(spark, sf_dir):
    """Catalog: the languages, plus the regions, which have no listing."""
    languages = table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).distinct()
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    catalog = languages.withColumn("mode", F.lit("feed")).unionByName(regions.withColumn("mode", F.lit("unused")))
    return stats.source_coverage(catalog, raw(spark, sf_dir))


def market_metrics(spark, sf_dir):
    shown = views.last_runs(_logged_runs(spark, sf_dir))
    return stats.market_metrics(enriched(spark, sf_dir), shown)


def skill_share(spark, sf_dir):
    return stats.skill_share(top_skills(spark, sf_dir)).withColumn("bar_percent", F.round("bar_percent", 6))


def search_listings(spark, sf_dir):
    return views.search_listings(listings(spark, sf_dir), " TION ").select("seq", "source")


def search_listings_source(spark, sf_dir):
    return views.search_listings(listings(spark, sf_dir), "with", "en").select("seq", "source")


def listing_card(spark, sf_dir):
    return views.listing_card(listings(spark, sf_dir).withColumn("location", F.nullif("location", F.lit("en"))))


def recent_listings(spark, sf_dir):
    rows = views.recent_listings(listings(spark, sf_dir))
    return _printable(rows)


def listing_preview(spark, sf_dir):
    return _printable(views.listing_preview(listings(spark, sf_dir)))


def _printable(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "skills": skill_text(),
            "ingested_at": F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss"),
            "posted_at": F.coalesce("posted_at", F.lit("-")),
        }
    )


# Run log over events: a run is a day, a source one of ten user groups


def _events(spark, sf_dir):
    outcomes = F.create_map(
        *[
            F.lit(x)
            for x in (
                "view", "fetched", "purchase", "stored", "signup", "skipped_dedup",
                "click", "skipped_low_confidence", "error", "error",
            )
        ]
    )
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyyMMdd").alias("run_id"),
        F.concat(F.lit("group"), (F.col("user_id") % 10).cast("string")).alias("source"),
        outcomes[F.col("event_type")].alias("outcome"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "props",
    )


def run_counters(spark, sf_dir):
    return runs.run_counters(_events(spark, sf_dir), F.col("outcome"))


def run_errors(spark, sf_dir):
    events = _events(spark, sf_dir)
    return runs.run_errors(events, F.col("outcome"), F.concat_ws(":", "event_id", "props"))


def _runs(spark, sf_dir):
    events = _events(spark, sf_dir)
    times = events.groupBy("run_id", "source").agg(F.min("ts").alias("started_at"), F.max("ts").alias("written_at"))
    return runs.run_counters(events, F.col("outcome")).join(times, ["run_id", "source"])


def _logged_runs(spark, sf_dir):
    return runs.latest_run(_runs(spark, sf_dir))


def _text_times(rows: DataFrame) -> DataFrame:
    pattern = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    named = {c: F.date_format(c, pattern) for c in ("started_at", "written_at") if c in rows.columns}
    return rows.withColumns(named)


def latest_run(spark, sf_dir):
    return _text_times(_logged_runs(spark, sf_dir))


def last_runs(spark, sf_dir):
    return _text_times(views.last_runs(_logged_runs(spark, sf_dir)))


def run_card(spark, sf_dir):
    return views.run_card(_runs(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))


def epoch_to_iso(spark, sf_dir):
    moment = F.col("ts").cast("timestamp")
    millis = F.unix_millis(moment)
    text = (
        F.when(F.col("event_type") == "view", millis.cast("string"))
        .when(F.col("event_type") == "click", F.floor(millis / 1000).cast("string"))
        .when(F.col("event_type") == "error", F.lit(""))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", t.epoch_to_iso(text).alias("posted_at"))


def age_label(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("ts").cast("string"))
    as_of = F.lit(AS_OF).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", t.age_label(text, as_of).alias("age"))


# Vectors and answers


def _vector_listings(spark, sf_dir):
    label = F.col("label").cast("string")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("title"),
        F.concat(F.lit("label "), label).alias("company"),
        F.concat(F.lit("https://vec.example/"), F.col("vec_id").cast("string")).alias("url"),
        F.array(F.concat(F.lit("s"), label), F.lit("vector")).alias("skills"),
        "embedding",
        "label",
    )


def _mean_vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean vector per key, by position, so each position is averaged on its own."""
    positions = rows.select(*keys, F.posexplode("embedding").alias("pos", "x"))
    means = positions.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(*keys).agg(F.transform(packed, lambda p: p["x"]).alias("embedding"))


def _mean_vector(spark, sf_dir) -> list[float]:
    return _mean_vectors(table(spark, sf_dir, "embeddings")).first()["embedding"]


def _questions(spark, sf_dir):
    return _mean_vectors(_vector_listings(spark, sf_dir), "label").withColumnRenamed("label", "question_id")


def similarity_topk(spark, sf_dir):
    nearest = search.similarity_topk(_vector_listings(spark, sf_dir), _mean_vector(spark, sf_dir))
    return nearest.select("id", F.round("distance", 6).alias("distance"))


def rank_per_question(spark, sf_dir):
    ranked = search.rank_per_question(_questions(spark, sf_dir), _vector_listings(spark, sf_dir))
    return ranked.withColumn("distance", F.round("distance", 6))


def rank_many_questions(spark, sf_dir):
    """Every tenth vector as a question, some of them without a vector."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 10 = 0").select(
        F.col("vec_id").alias("question_id"), F.when(F.col("vec_id") % 70 != 0, F.col("embedding")).alias("embedding"))
    ranked = search.rank_per_question(asked, _vector_listings(spark, sf_dir), k=7)
    return ranked.withColumn("distance", F.round("distance", 6))


def cosine_distance(spark, sf_dir):
    """Distance of every vector to the mean of its label, as a Column expression."""
    means = _mean_vectors(_vector_listings(spark, sf_dir), "label").withColumnRenamed("embedding", "mean")
    rows = table(spark, sf_dir, "embeddings").join(means, "label")
    distance = vectors.cosine_distance(F.col("embedding"), F.col("mean"))
    return rows.select("vec_id", F.round(distance, 6).alias("distance"))


def hash_embed_documents(spark, sf_dir):
    embedded = spread(table(spark, sf_dir, "documents")).select("doc_id", hash_embed(F.col("text"), DIMS).alias("v"))
    weights = embedded.select("doc_id", F.posexplode("v").alias("bucket", "weight")).filter("weight > 0")
    return weights.withColumn("weight", F.col("weight").cast("double"))


def _retrieved(spark, sf_dir):
    return answers.retrieve(_questions(spark, sf_dir), _vector_listings(spark, sf_dir))


def retrieve(spark, sf_dir):
    return _retrieved(spark, sf_dir).withColumn("sources", F.array_join("sources", ","))


def answer_fallback(spark, sf_dir):
    return _retrieved(spark, sf_dir).select("question_id", answers.answer_fallback(F.col("context")).alias("answer"))


def answer_lines(spark, sf_dir):
    """The fallback answer over whole texts, whose lines become context lines."""
    context = F.regexp_replace("text", r"(?m)^([A-M])", "- $1")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", answers.answer_fallback(context).alias("answer"))


# Pages


def _pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"))


def strip_html(spark, sf_dir):
    text = clean_html_text(F.col("html"))
    rows = _pages(spark, sf_dir).withColumn("text", text)
    return rows.select("page_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def page_titles(spark, sf_dir):
    rows = _pages(spark, sf_dir).withColumn("page", page_fields(F.col("html")))
    return rows.select("page_id", "page.title", "page.h1", F.coalesce("page.h2", F.lit("")).alias("h2"))


def _script(value: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">'), value, F.lit("</script>"))


def _posting(title: Column, description: Column, company: Column, locality: Column, date: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("JobPosting").alias("@type"),
            title.alias("title"),
            description.alias("description"),
            F.struct(company.alias("name")).alias("hiringOrganization"),
            F.struct(F.struct(locality.alias("addressLocality")).alias("address")).alias("jobLocation"),
            date.alias("datePosted"),
        )
    )


def json_ld_postings(spark, sf_dir):
    """One page per document: a foreign block, broken JSON, then the posting."""
    posting = _posting(F.col("title"), F.col("description"), F.col("company"), F.col("location"), F.col("seq").cast("string"))
    body = F.concat(
        F.lit("<html><!-- "), _script(F.lit('{"@type":"JobPosting"}')), F.lit(" -->"),
        _script(F.lit('[{"@type":"Organization"}]')), _script(F.lit("{broken")), _script(posting),
    )
    documents = raw_from(spread(table(spark, sf_dir, "documents")))
    rows = pages.with_posting(documents.select("seq", body.alias("body")))
    return rows.select(
        "seq", "ld_title", "ld_company", "ld_location", "ld_date",
        F.md5("ld_html").alias("digest"), F.size("blocks").alias("n_blocks"),
    )


def json_ld_shapes(spark, sf_dir):
    """Locations and companies as object, list or text, in lists up to six deep, and the page date of a graph."""
    lang, source = F.col("lang"), F.col("source")

    def place(text: Column) -> Column:
        return F.to_json(F.struct(F.struct(text.alias("addressRegion")).alias("address")))

    location = (
        F.when(lang == "en", place(source))
        .when(lang == "fr", F.concat(F.lit("["), place(source), F.lit(","), place(lang), F.lit("]")))
        .when(lang == "de", F.concat(F.lit('{"address":['), place(source), F.lit(',{"addressRegion":"x"}]}')))
        .otherwise(F.lit('"somewhere"'))
    )
    # further documents have their lists in lists, and addresses in addresses, as deep as their id says
    depth = (F.col("doc_id") % 7).cast("int")

    def deep(value: Column, opening: str, closing: str) -> Column:
        return F.concat(F.repeat(F.lit(opening), depth), value, F.repeat(F.lit(closing), depth))

    location = (
        F.when(lang == "fr", deep(location, "[", "]"))
        .when(lang == "de", deep(location, '{"address":[', ']}'))
        .otherwise(location)
    )
    company = (
        F.when(lang == "en", F.to_json(F.struct(source.alias("name"))))
        .when(lang == "fr", F.concat(F.lit('[{"name":""},'), F.to_json(F.struct(source.alias("name"))), F.lit("]")))
        .otherwise(F.concat(F.lit('"'), source, F.lit('"')))
    )
    company = F.when(lang == "fr", deep(company, '["",', "]")).otherwise(company)
    graph = F.concat(
        F.lit('{"@graph":[{"@type":"Person"},{"@type":"WebPage","datePublished":"'),
        F.col("doc_id").cast("string"),
        F.lit('"}]}'),
    )
    body = F.concat(
        _script(F.lit('{"@graph":"none"}')), _script(graph),
        _script(F.concat(F.lit('{"l":'), location, F.lit(',"c":'), company, F.lit("}"))),
    )
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", body.alias("body"))
    blocks = rows.withColumn("blocks", jsonld.json_ld_blocks(jsonld.json_ld_scripts(F.col("body"))))
    last = F.element_at("blocks", -1)
    return blocks.select(
        "doc_id",
        jsonld.extract_location(F.try_variant_get(last, "$.l", "variant")).alias("location"),
        jsonld.extract_company(F.try_variant_get(last, "$.c", "variant")).alias("company"),
        jsonld.webpage_date(F.col("blocks")).alias("published"),
    )


def _page_captures(spark, sf_dir, source: str, html: Column | None = None) -> DataFrame:
    """Pages as captures; the English ones carry a job posting as well."""
    posting = _posting(
        F.concat(F.lit("Role of the "), F.col("page_id").cast("string")), F.col("html"), F.lit("Poster"),
        F.lit("Pune"), F.lit("2024-01-01"),
    )
    carried = F.when(F.col("url").contains("/en/"), _script(F.replace(posting, F.lit("</"), F.lit("<\\/"))))
    body = F.concat(F.col("html") if html is None else html, F.coalesce(carried, F.lit("")))
    return _pages(spark, sf_dir).select(
        F.lit(source).alias("source"), F.lit("page").alias("kind"), F.lit(None).cast("string").alias("board"),
        "url", body.alias("body"), F.lit(0).alias("page"), F.col("page_id").alias("seq"),
    )


def _search_records(spark, sf_dir, source: str) -> DataFrame:
    """One record per secure page, as a search result page would have given it."""
    found = table(spark, sf_dir, "pages").filter(F.col("url").startswith("https:"))
    return found.select(
        F.lit(source).alias("source"), "url",
        F.concat(F.lit("Found of the "), F.col("page_id").cast("string")).alias("title"),
        F.lit("Finder").alias("company"), F.lit("").alias("location"), F.lit("yesterday").alias("posted_at"),
        F.lit("Found text").alias("description"), F.col("page_id").alias("seq"), F.lit(0).alias("pos"),
    )


def _raw_view(rows: DataFrame) -> DataFrame:
    return rows.select(
        "source", "seq", "pos", "title", "company", "url", F.md5("description").alias("digest"), "location",
        F.coalesce("posted_at", F.lit("-")).alias("posted_at"), "fetched", "matched",
    )


def page_cutshort(spark, sf_dir):
    return _raw_view(pages.page_cutshort(_page_captures(spark, sf_dir, "cutshort"), "of"))


def page_foundit(spark, sf_dir):
    return _raw_view(pages.page_foundit(_page_captures(spark, sf_dir, "foundit"), "of"))


def page_foundit_demo(spark, sf_dir):
    source = "foundit_demo"
    records = _search_records(spark, sf_dir, source)
    return _raw_view(pages.page_foundit_demo(_page_captures(spark, sf_dir, source), records, "of"))


def page_forage_ai(spark, sf_dir):
    return _raw_view(pages.page_forage_ai(_page_captures(spark, sf_dir, "forage_ai"), "e"))


def page_greenhouse_rendered(spark, sf_dir):
    source = "greenhouse_playwright"
    html = F.replace(F.col("html"), F.lit("<article>"), F.lit('<article id="content"><i class="location">Goa</i>'))
    return _raw_view(pages.page_greenhouse_rendered(_page_captures(spark, sf_dir, source, html), "e"))


def page_indeed(spark, sf_dir):
    html = F.replace(F.col("html"), F.lit("<article>"), F.lit('<article id="jobDescriptionText">'))
    captures = _page_captures(spark, sf_dir, "indeed", html)
    return _raw_view(pages.page_indeed(captures, _search_records(spark, sf_dir, "indeed")))


def page_ddg(spark, sf_dir):
    captures = _page_captures(spark, sf_dir, "ddg")
    return _raw_view(pages.page_ddg(captures, _search_records(spark, sf_dir, "ddg")))


def page_ddg_whole(spark, sf_dir):
    captures = _page_captures(spark, sf_dir, "ddg")
    return _raw_view(pages.page_ddg(captures, _search_records(spark, sf_dir, "ddg"), max_chars=None))


def attach_search_record(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.lit("x").alias("source"), "url", F.col("page_id").alias("seq"))
    joined = pages.attach_search_record(rows, _search_records(spark, sf_dir, "x"))
    return joined.select(F.col("seq").alias("page_id"), F.coalesce("found_title", F.lit("-")).alias("title"))


# Feeds: one payload per document, one job per line of its text


def _payloads(spark, sf_dir, source: str, job: Callable[[Column], Column], wrap: Callable[[Column], Column]):
    lines = F.split("text", "\n")
    body = F.to_json(wrap(F.transform(lines, job)))
    # Renamed first: a lambda would take the column for the alias of the same select.
    documents = spread(table(spark, sf_dir, "documents")).withColumnRenamed("source", "board")
    return documents.select(
        F.lit(source).alias("source"), F.lit("feed").alias("kind"), "board",
        F.concat(F.lit("https://feed.example/"), F.col("lang")).alias("url"), body.alias("body"),
        F.lit(1).alias("page"), F.col("doc_id").alias("seq"),
    )


def _html(line: Column) -> Column:
    return F.concat(F.lit("&lt;p&gt;<b>"), line, F.lit("</b>&lt;/p&gt;"))


def _if_lang(lang: str, value: Column) -> Column:
    return F.when(F.col("lang") == lang, value)


def _arbeitnow_captures(spark, sf_dir):
    def job(line):
        return F.struct(
            line.alias("title"), _html(line).alias("description"), F.col("board").alias("company_name"),
            F.lit("https://a").alias("url"), _if_lang("en", F.lit("Berlin")).alias("location"),
            (F.col("lang") == "fr").alias("remote"), (F.col("doc_id") * 1000).alias("created_at"),
        )

    return _payloads(spark, sf_dir, "arbeitnow", job, lambda jobs: F.struct(jobs.alias("data")))


def feed_arbeitnow(spark, sf_dir):
    return _raw_view(feeds.feed_arbeitnow(_arbeitnow_captures(spark, sf_dir), ROLE))


def _ashby_captures(spark, sf_dir):
    def job(line):
        return F.struct(
            line.alias("title"), _if_lang("en", _html(line)).alias("descriptionHtml"), line.alias("descriptionPlain"),
            _if_lang("de", F.lit("https://j")).alias("jobUrl"), F.lit("https://apply").alias("applyUrl"),
            _if_lang("en", F.lit("Pune")).alias("location"), (F.col("lang") != "de").alias("isRemote"),
            F.lit("2024").alias("publishedAt"),
        )

    return _payloads(spark, sf_dir, "ashby", job, lambda jobs: F.struct(jobs.alias("jobs")))


def feed_ashby(spark, sf_dir):
    return _raw_view(feeds.feed_ashby(_ashby_captures(spark, sf_dir), ROLE))


def _greenhouse_captures(spark, sf_dir):
    def job(line):
        return F.struct(
            line.alias("title"), _html(line).alias("content"), _if_lang("fr", F.lit("Firm")).alias("company_name"),
            F.lit("https://g").alias("absolute_url"),
            F.struct(_if_lang("en", F.lit("Pune")).alias("name")).alias("location"),
            _if_lang("de", F.lit("first")).alias("first_published"), F.lit("later").alias("updated_at"),
        )

    return _payloads(spark, sf_dir, "greenhouse", job, lambda jobs: F.struct(jobs.alias("jobs")))


def feed_greenhouse(spark, sf_dir):
    return _raw_view(feeds.feed_greenhouse(_greenhouse_captures(spark, sf_dir), ROLE))


def _himalayas_captures(spark, sf_dir):
    def job(line):
        return F.struct(
            line.alias("title"), _html(line).alias("description"), F.col("board").alias("companyName"),
            F.lit("https://guid").alias("guid"),
            _if_lang("en", F.array(F.lit("India"), F.col("board"))).alias("locationRestrictions"),
            (F.col("doc_id") + 1700000000).alias("pubDate"),
        )

    def wrap(jobs):
        return F.struct(jobs.alias("jobs"), F.size(F.split("text", "\n")).alias("totalCount"))

    return _payloads(spark, sf_dir, "himalayas", job, wrap)


def feed_himalayas(spark, sf_dir):
    return _raw_view(feeds.feed_himalayas(_himalayas_captures(spark, sf_dir), ROLE))


def himalayas_next(spark, sf_dir):
    return frontier.himalayas_next(_himalayas_captures(spark, sf_dir))


def _lever_captures(spark, sf_dir):
    def job(line):
        return F.struct(
            line.alias("text"), F.lit("").alias("openingPlain"), line.alias("descriptionPlain"),
            F.array(F.struct(_html(line).alias("content")), F.struct(F.lit("end").alias("content"))).alias("lists"),
            F.struct(_if_lang("en", F.lit("Pune")).alias("location")).alias("categories"),
            F.lit("https://l").alias("hostedUrl"), (F.col("doc_id") + 1700000000000).alias("createdAt"),
        )

    return _payloads(spark, sf_dir, "lever", job, lambda jobs: jobs)


def feed_lever(spark, sf_dir):
    return _raw_view(feeds.feed_lever(_lever_captures(spark, sf_dir), ROLE))


def _foundit_captures(spark, sf_dir):
    def job(line):
        return F.struct(
            _if_lang("fr", F.lit("ad")).alias("type"), line.alias("title"), line.alias("summary"),
            _if_lang("de", F.lit("/job/x")).alias("seoJdUrl"), F.col("doc_id").alias("id"),
            F.col("board").alias("companyName"), F.lit("Pune").alias("locations"), F.lit("new").alias("postedAt"),
        )

    def wrap(jobs):
        return F.struct(F.struct(jobs.alias("data")).alias("jobSearchResponse"))

    return _payloads(spark, sf_dir, "foundit_demo", job, wrap)


def feed_foundit_search(spark, sf_dir):
    found = feeds.feed_foundit_search(_foundit_captures(spark, sf_dir), "e")
    return found.select("seq", "pos", "url", "title", "company", "posted_at", F.md5("description").alias("digest"))


def _secure_pages(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir).filter(F.col("url").startswith("https:"))


def _search_captures(spark, sf_dir) -> list[DataFrame]:
    """One search result per secure page for each of the three searched sources."""
    title = F.concat(F.lit("Found of the "), F.col("page_id").cast("string"))
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    job = F.struct(title.alias("title"), F.lit("Found text").alias("summary"), F.col("url").alias("seoJdUrl"), F.lit("Finder").alias("companyName"))
    bodies = {
        ("foundit_demo", "feed"): F.to_json(F.struct(F.struct(F.array(job).alias("data")).alias("jobSearchResponse"))),
        ("indeed", "search"): _card(F.col("url"), title, F.lit("Finder"), F.lit("Pune")),
        ("ddg", "search"): F.concat(F.lit('<a class="result__a" href="'), escaped, F.lit('">'), title, F.lit("</a><a class=result__a>none</a>")),
    }
    return [
        _secure_pages(spark, sf_dir).select(
            F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("board"),
            F.lit("https://search.example/").alias("url"), body.alias("body"), F.lit(0).alias("page"), F.col("page_id").alias("seq"))
        for (source, kind), body in bodies.items()
    ]


def _captures_of_all(spark, sf_dir) -> DataFrame:
    feeds_of = (_arbeitnow_captures, _ashby_captures, _greenhouse_captures, _himalayas_captures, _lever_captures)
    html = {
        "forage_ai": None, "cutshort": None, "foundit": None, "foundit_demo": None, "ddg": None,
        "greenhouse_playwright": F.replace(F.col("html"), F.lit("<article>"), F.lit('<article id="content"><i class="location">Goa</i>')),
        "indeed": F.replace(F.col("html"), F.lit("<article>"), F.lit('<article id="jobDescriptionText">')),
    }
    parts = [make(spark, sf_dir) for make in feeds_of]
    parts += [_page_captures(spark, sf_dir, source, body) for source, body in html.items()]
    return union_sources(parts + _search_captures(spark, sf_dir)).withColumn("fetched_at", F.lit(None).cast("timestamp"))


def union_feeds(spark, sf_dir):
    rows = union_sources(
        [
            feeds.feed_arbeitnow(_arbeitnow_captures(spark, sf_dir), ROLE),
            feeds.feed_ashby(_ashby_captures(spark, sf_dir), ROLE),
            feeds.feed_greenhouse(_greenhouse_captures(spark, sf_dir), ROLE),
            feeds.feed_himalayas(_himalayas_captures(spark, sf_dir), ROLE),
            feeds.feed_lever(_lever_captures(spark, sf_dir), ROLE),
        ]
    )
    return rows.groupBy("source").agg(F.sum("fetched").alias("fetched"), F.countDistinct("seq").alias("n_payloads"))


def union_all_sources(spark, sf_dir):
    """All twelve adapters over one stored table of captures, with the counts of each source."""
    base = _fresh_root(spark, "captures")
    write_captures(_captures_of_all(spark, sf_dir), f"{base}/captures", gather=False)

    def stage(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{base}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{base}/{name}")

    rows, counts = raw_listings(read_captures(spark, f"{base}/captures"), ROLE, ALL_SOURCES, stage)
    summed = rows.groupBy("source").agg(
        F.sum("fetched").alias("fetched"), F.count_if("matched").alias("matched"), F.countDistinct("seq").alias("n_payloads"),
        F.sum(F.when(F.col("matched"), F.length("title"))).alias("title_chars"),
        F.sum(F.when(F.col("matched"), F.length("description"))).alias("description_chars"))
    counted = counts.groupBy("source").agg(F.sum("fetched").alias("more"))
    nothing = F.lit(0).cast("long")
    return counted.join(summed, "source", "left").select(
        "source", (F.coalesce("fetched", nothing) + F.col("more")).alias("fetched"),
        *(F.coalesce(c, nothing).alias(c) for c in ("matched", "n_payloads", "title_chars", "description_chars")))


# Frontier


def _sitemaps(spark, sf_dir, source: str, references: bool = False) -> DataFrame:
    """Sitemaps of up to 50 pages each; every url is listed twice."""
    encoded = F.replace("url", F.lit("&"), F.lit("&amp;"))
    if references:
        # a character of another plane by its number, one by its number in hex, one that there is none of, or CDATA
        number = F.col("page_id") % 4
        encoded = F.when(number == 0, F.concat(encoded, F.lit("&#70000;"))).when(number == 1, F.concat(encoded, F.lit("&#x1F600;&#65;"))).when(
            number == 2, F.concat(encoded, F.lit("&#x110000;"))).otherwise(F.concat(F.lit("<![CDATA["), "url", F.lit("&#65;]]>")))
    loc = F.concat(F.lit("<url><loc>"), encoded, F.lit("</loc></url>"))
    maps = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 50).alias("seq")).agg(
        F.array_sort(F.collect_list(F.struct("page_id", F.concat(loc, loc).alias("loc")))).alias("locs")
    )
    body = F.concat(
        F.lit("<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"),
        F.array_join(F.transform("locs", lambda entry: entry["loc"]), ""),
        F.lit("</urlset>"),
    )
    return maps.select(F.lit(source).alias("source"), F.lit("sitemap").alias("kind"), "seq", body.alias("body"))


def sitemap_urls(spark, sf_dir):
    return frontier.sitemap_urls(_sitemaps(spark, sf_dir, "any", references=True))


def sitemap_distinct(spark, sf_dir):
    return frontier.cutshort_frontier(_sitemaps(spark, sf_dir, "cutshort"), "en example")


def sitemap_repeated(spark, sf_dir):
    return frontier.foundit_frontier(_sitemaps(spark, sf_dir, "foundit"), "en example")


def sitemap_reversed(spark, sf_dir):
    maps = _sitemaps(spark, sf_dir, "forage_ai").withColumn("body", F.replace("body", F.lit("/en/"), F.lit("/job-opportunities/")))
    return frontier.forage_frontier(maps)


def page_frontier(spark, sf_dir):
    roles = text_lines(spark, sf_dir).select("seq", "pos", F.col("line").alias("role"))
    return frontier.indeed_pages(roles).select("seq", "pos", "page", "start", "url")


def ddg_search(spark, sf_dir):
    return frontier.ddg_search(text_lines(spark, sf_dir).select("seq", "pos", F.col("line").alias("role"))).drop("role")


def foundit_search(spark, sf_dir):
    return frontier.foundit_search(text_lines(spark, sf_dir).select("seq", "pos", F.col("line").alias("role"))).drop("role")


def arbeitnow_next(spark, sf_dir):
    """Captured feed pages that link to a further page, to an empty one, or to none."""
    link = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://feed.example/"), F.md5("text"))).when(F.col("doc_id") % 3 == 1, F.lit(""))
    body = F.to_json(F.struct(F.struct(link.alias("next")).alias("links"), F.col("text").alias("note")))
    captures = table(spark, sf_dir, "documents").select(
        F.lit("arbeitnow").alias("source"), F.lit("feed").alias("kind"), F.lit(None).cast("string").alias("board"),
        F.lit("https://feed.example").alias("url"), body.alias("body"), (F.col("doc_id") % 4 + 1).cast("int").alias("page"),
        F.col("doc_id").alias("seq"), F.lit(None).cast("timestamp").alias("fetched_at"))
    return frontier.arbeitnow_next(captures)


def has_embedding(spark, sf_dir):
    rows = _vector_listings(spark, sf_dir)
    some = rows.withColumn("embedding", F.when(F.col("id") % 7 != 0, F.col("embedding")))
    return search.has_embedding(some).select("id", F.size("embedding").alias("width"))


def foundit_pages(spark, sf_dir):
    """Page state in the script of each page, planned into result requests."""
    state = F.concat(
        F.lit("<script>var _seoHtmlProps_ = "), F.to_json(F.struct((F.col("page_id") + 5).alias("limit"), F.col("url").alias("query"))),
        F.lit(";</script>"),
    )
    searches = _pages(spark, sf_dir).select(
        F.lit("foundit_demo").alias("source"), F.lit("search").alias("kind"), F.col("page_id").alias("seq"),
        F.concat("html", state).alias("body"),
    )
    return frontier.foundit_pages(searches, "role").drop("source")


def board_frontier(spark, sf_dir):
    boards = F.when(F.col("c_acctbal") > 0, F.concat_ws(" , ", F.lower("c_mktsegment"), "c_name", F.lit("")))
    requests = table(spark, sf_dir, "customer").select("c_custkey", boards.alias("boards"))
    return frontier.board_frontier(requests, "greenhouse").select("c_custkey", "board", "url")


def _link_pages(spark, sf_dir, source: str, kind: str, before: str, after: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        F.lit(source).alias("source"), F.lit(kind).alias("kind"), "url", F.col("page_id").alias("seq"),
        F.replace("html", F.lit(before), F.lit(after)).alias("body"),
    )


def board_link_frontier(spark, sf_dir):
    captures = _link_pages(spark, sf_dir, "greenhouse_playwright", "board", '<a href="/', '<a href="/jobs/')
    return frontier.board_link_frontier(captures, "e")


def result_link_frontier(spark, sf_dir):
    captures = _link_pages(spark, sf_dir, "ddg", "search", "<a href", '<a class="result__a" href')
    return frontier.result_link_frontier(captures).select("seq", "pos", "url", "title", "fetched")


def card_frontier(spark, sf_dir):
    """One result page per document with one card per line of its text."""
    def card(line: Column) -> Column:
        return F.concat(
            F.lit('<div class="job_seen_beacon"><h2><a href="/v?jk='), F.md5(line), F.lit('"><span> '),
            F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("</span></a></h2><span class=companyName>"),
            F.col("board"), F.lit('</span><div class="companyLocation">'), F.col("lang"), F.lit("</div></div>"),
        )

    body = F.array_join(F.transform(F.split("text", "\n"), card), "")
    captures = spread(table(spark, sf_dir, "documents")).withColumnRenamed("source", "board").select(
        F.lit("indeed").alias("source"), F.lit("search").alias("kind"), F.lit("https://in.indeed.com/jobs?q=x").alias("url"),
        F.col("doc_id").alias("seq"), F.concat(F.lit("<body>"), body).alias("body"),
    )
    return frontier.card_frontier(captures).select("seq", "pos", "url", "title", "company", "location", "fetched")


QUERIES: dict[str, Query] = {
    "normalize_text": normalize_text,
    "collapse_ws": collapse_ws,
    "embedding_text": embedding_text,
    "embedding_text_whole": embedding_text_whole,
    "slugify_title": slugify_title,
    "board_title": board_title,
    "required_fields": required_fields,
    "role_filter": role_filter,
    "enrich_documents": enrich_documents,
    "enrich_with_model": enrich_with_model,
    "confidence_kept": confidence_kept,
    "listing_ids_first": listing_ids_first,
    "drop_known": drop_known,
    "ingest_outcomes": ingest_outcomes,
    "ingest_new_listings": ingest_new_listings,
    "ingest_batch": ingest_batch_store,
    "ingest_stream": ingest_stream_store,
    "ingest_run_log": ingest_run_log,
    "ingest_compacted": ingest_compacted,
    "ingest_captures": ingest_captures,
    "ingest_captures_pages": ingest_captures_pages,
    "total_listings": total_listings,
    "by_source": by_source,
    "top_skills": top_skills,
    "stats": stats_bundle,
    "source_coverage": source_coverage,
    "market_metrics": market_metrics,
    "skill_share": skill_share,
    "search_listings": search_listings,
    "search_listings_source": search_listings_source,
    "listing_card": listing_card,
    "recent_listings": recent_listings,
    "listing_preview": listing_preview,
    "run_counters": run_counters,
    "run_errors": run_errors,
    "ingest_two_streams": ingest_two_streams,
    "ingest_per_source": ingest_per_source,
    "ingest_errors": ingest_errors,
    "insert_if_absent": insert_if_absent,
    "ddg_search": ddg_search,
    "foundit_search": foundit_search,
    "arbeitnow_next": arbeitnow_next,
    "has_embedding": has_embedding,
    "latest_run": latest_run,
    "last_runs": last_runs,
    "run_card": run_card,
    "epoch_to_iso": epoch_to_iso,
    "age_label": age_label,
    "similarity_topk": similarity_topk,
    "rank_per_question": rank_per_question,
    "rank_many_questions": rank_many_questions,
    "cosine_distance": cosine_distance,
    "hash_embed": hash_embed_documents,
    "retrieve": retrieve,
    "answer_fallback": answer_fallback,
    "answer_with_model": answer_with_model,
    "answer_lines": answer_lines,
    "strip_html": strip_html,
    "page_titles": page_titles,
    "json_ld_postings": json_ld_postings,
    "json_ld_shapes": json_ld_shapes,
    "page_cutshort": page_cutshort,
    "page_foundit": page_foundit,
    "page_foundit_demo": page_foundit_demo,
    "page_forage_ai": page_forage_ai,
    "page_greenhouse_rendered": page_greenhouse_rendered,
    "page_indeed": page_indeed,
    "page_ddg": page_ddg,
    "page_ddg_whole": page_ddg_whole,
    "attach_search_record": attach_search_record,
    "feed_arbeitnow": feed_arbeitnow,
    "feed_ashby": feed_ashby,
    "feed_greenhouse": feed_greenhouse,
    "feed_himalayas": feed_himalayas,
    "feed_lever": feed_lever,
    "feed_foundit_search": feed_foundit_search,
    "union_sources": union_feeds,
    "union_all_sources": union_all_sources,
    "himalayas_next": himalayas_next,
    "sitemap_urls": sitemap_urls,
    "sitemap_distinct": sitemap_distinct,
    "sitemap_repeated": sitemap_repeated,
    "sitemap_reversed": sitemap_reversed,
    "page_frontier": page_frontier,
    "foundit_pages": foundit_pages,
    "board_frontier": board_frontier,
    "board_link_frontier": board_link_frontier,
    "result_link_frontier": result_link_frontier,
    "card_frontier": card_frontier,
}
