import json
import os
import random

import pytest
from pyspark.sql import functions as F

from joblattice.operators.dedup import drop_known, first_arrival
from joblattice.operators.enrich import ModelUnavailable, enrich, enrich_with
from joblattice.operators.runs import latest_run, run_counters, run_errors
from joblattice.operators.validate import reject_reason, required_fields
from joblattice.plans.adapters import raw_listings
from joblattice.plans.ingest import default_embedder, ingest_batch
from joblattice.session import scratch_dir
from joblattice.sources import store as tables
from joblattice.streaming.ingest import ingest_captures_stream, ingest_stream

RAW = (
    "title string, company string, url string, description string, location string, source string, "
    "posted_at string, seq long, fetched int, matched boolean"
)
GOOD, WEAK = "Python engineer services", "marketing role"


def raw_row(seq, url="u", description=GOOD, source="s", title="T", company="C", matched=True, fetched=1):
    return (title, company, url, description, "  Bengaluru   India ", source, None, seq, fetched, matched)


@pytest.fixture
def raw(spark):
    return lambda *rows: spark.createDataFrame(list(rows), RAW)


EMBED = default_embedder(16)


def log_of(frame):
    return {row["source"]: row.asDict() for row in frame.collect()}


def test_required_fields(raw):
    frame = raw(
        raw_row(1), raw_row(2, title="  "), raw_row(3, company=" "), raw_row(4, description=None),
        raw_row(5, title=None, company=None),
    )
    reasons = [r[0] for r in frame.select(reject_reason()).collect()]
    assert reasons == [None, "title", "company", "description", "title"]
    assert required_fields(frame).count() == 1


def test_enrich(spark):
    texts = [
        "We need a Python engineer with Docker, Kubernetes and FastAPI experience.", "JavaScript", "PostgreSQL dev",
        "Backend work", "frontends", "Machine Learning", None, "élengineer",
    ]
    frame = enrich(spark.createDataFrame([(t,) for t in texts], "description string"))
    rows = [(r["skills"], r["confidence"]) for r in frame.collect()]
    assert rows == [
        (["Docker", "Fastapi", "Kubernetes", "Python"], 0.8), (["Java", "Javascript"], 0.8),
        (["Postgresql", "Sql"], 0.8), ([], 0.75), ([], 0.45), (["Machine Learning"], 0.8), ([], 0.45), ([], 0.45),
    ]


def test_outcomes(spark, raw, tmp_path):
    frame = raw(
        raw_row(3, "a", GOOD, title="late"), raw_row(1, "a", WEAK), raw_row(2, "a", GOOD, title="first"),
        raw_row(4, "b", WEAK), raw_row(5, "b", WEAK), raw_row(6, "c", title=" "),
        raw_row(7, "d", matched=False), raw_row(8, "e", source="other"),
    )
    log = log_of(ingest_batch(frame, str(tmp_path), "run", embedder=EMBED))
    stored = {r["url"]: r for r in tables.read_listings(spark, str(tmp_path)).collect()}
    assert set(stored) == {"a", "e"} and stored["a"]["title"] == "first"
    assert stored["a"]["location"] == "Bengaluru India" and len(stored["a"]["id"]) == 64
    assert (log["s"]["fetched"], log["s"]["stored"]) == (7, 1)
    assert (log["s"]["skipped_dedup"], log["s"]["skipped_low_confidence"]) == (1, 3)
    assert log["other"]["stored"] == 1


def test_ingest_twice_and_retry(spark, raw, tmp_path):
    root = str(tmp_path / "store")
    frame = raw(raw_row(1, "a"), raw_row(2, "a"), raw_row(3, "b", WEAK), raw_row(4, "c"))
    first = log_of(ingest_batch(frame, root, "run1", batch_id="b1", embedder=EMBED))["s"]
    assert (first["fetched"], first["stored"], first["skipped_dedup"], first["skipped_low_confidence"]) == (4, 2, 1, 1)
    listings = tables.read_listings(spark, root)
    assert listings.count() == 2 and listings.filter(F.size("embedding") == 16).count() == 2

    retried = log_of(ingest_batch(frame, root, "run1", batch_id="b1", embedder=EMBED))["s"]
    assert retried["stored"] == 2 and tables.read_listings(spark, root).count() == 2

    again = log_of(ingest_batch(frame, root, "run2", embedder=EMBED))["s"]
    assert (again["stored"], again["skipped_dedup"], again["skipped_low_confidence"]) == (0, 3, 1)
    assert tables.read_listings(spark, root).count() == 2
    assert tables.read_runs(spark, root).count() == 2


@pytest.fixture
def model():
    def load():
        def reply(texts):
            if any("down" in t for t in texts):
                raise ModelUnavailable("503")
            answers = []
            for text in texts:
                if "boom" in text:
                    raise RuntimeError("boom")
                good = json.dumps({"skills": [" Go ", "", 3, "Go"], "confidence": 0.9})
                answers.append("no json" if "garbled" in text else good)
            return answers

        return reply

    return load


def test_model_enrichment(spark, model):
    texts = ["fine", "Python down", "boom", "garbled software"]
    frame = spark.createDataFrame([(t, "u") for t in texts], "description string, url string").coalesce(1)
    rows = [(r["skills"], r["confidence"], r["error"]) for r in enrich_with(frame, model).collect()]
    assert rows == [
        (["Go", "3", "Go"], 0.9, None), (["Python"], 0.8, None), ([], 0.0, "enrich:u:boom"), ([], 0.75, None),
    ]


def test_model_ingest(spark, raw, tmp_path, model):
    root = str(tmp_path / "store")
    ingest_batch(raw(raw_row(1, "known")), root, "run0", embedder=EMBED)
    frame = raw(*[raw_row(i, "known") for i in range(7)], raw_row(8, "x", "boom"), raw_row(9, "y"), raw_row(10, "y"))
    run = log_of(
        ingest_batch(
            frame, root, "run1", embedder=EMBED, model_enricher=lambda rows: enrich_with(rows, model), rows_per_slice=2
        )
    )["s"]
    assert (run["stored"], run["skipped_dedup"], run["skipped_low_confidence"]) == (1, 8, 1)
    assert run["error_count"] == 1 and run["fetched"] == 10
    assert [r["error"] for r in tables.read_run_errors(spark, root).collect()] == ["enrich:x:boom"]


def test_drop_known_with_hot_ids(spark):
    rows = [("hot" if i % 3 == 0 else f"id{i % 50}", i, 0) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id string, seq long, pos int")
    store = spark.createDataFrame([("hot",), ("id1",), ("id7",), ("gone",)], "id string")
    kept = drop_known(frame, store, rows_per_slice=100)
    expected = sorted(r for r in rows if r[0] not in {"hot", "id1", "id7"})
    assert sorted(tuple(r) for r in kept.select("id", "seq", "pos").collect()) == expected
    assert kept.columns == ["id", "seq", "pos"]


def test_first_arrival_prunes_before_the_shuffle(spark):
    rows = [("hot" if i % 2 else f"k{i % 7}", (i * 7919) % 1000, 0) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id string, seq long, pos int")
    kept = first_arrival(frame)
    best = {}
    for key, seq, _ in rows:
        best[key] = min(seq, best.get(key, seq))
    assert {r["id"]: r["seq"] for r in kept.collect()} == best
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_one_run_source_by_source(spark, raw, tmp_path):
    root = str(tmp_path / "store")
    for source in ("s", "t", "u"):
        ingest_batch(raw(raw_row(1, "a", source=source)), root, "run", embedder=EMBED)
    assert tables.read_listings(spark, root).count() == 3
    assert sorted(r["source"] for r in tables.read_runs(spark, root).collect()) == ["s", "t", "u"]


def test_two_streams_into_one_store(spark, raw, tmp_path):
    root = str(tmp_path / "store")
    for name in ("one", "two"):
        raw(raw_row(1, name)).coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(RAW).parquet(str(tmp_path / name))
        ingest_stream(stream, lambda b: b, root, str(tmp_path / f"cp-{name}"), embedder=EMBED).awaitTermination()
    assert {r["url"] for r in tables.read_listings(spark, root).collect()} == {"one", "two"}
    assert tables.read_runs(spark, root).count() == 2


def test_no_scratch_is_left(spark, raw, tmp_path):
    before = set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    ingest_batch(raw(raw_row(1, "a")), str(tmp_path / "store"), "run", embedder=EMBED)
    assert set(os.listdir(scratch_dir(spark).removeprefix("file:"))) == before


def test_random_batches_match_a_row_by_row_model(spark, raw, tmp_path):
    rng = random.Random(5)
    root = str(tmp_path / "store")
    stored, seq = set(), 0
    for batch in range(3):
        expected = {"stored": 0, "skipped_dedup": 0, "skipped_low_confidence": 0}
        known, rows = set(stored), []
        for _ in range(60):
            seq += 1
            url, text = f"u{rng.randrange(20)}", rng.choice([GOOD, WEAK, WEAK])
            rows.append(raw_row(seq, url, text))
            if url in known:
                expected["skipped_dedup"] += 1
            elif text == WEAK:
                expected["skipped_low_confidence"] += 1
            elif url in stored:
                expected["skipped_dedup"] += 1
            else:
                stored.add(url)
                expected["stored"] += 1
        rng.shuffle(rows)
        log = log_of(ingest_batch(raw(*rows), root, f"run{batch}", embedder=EMBED))["s"]
        assert {name: log[name] for name in expected} == expected
    assert {r["url"] for r in tables.read_listings(spark, root).collect()} == stored


def test_stream_equals_batch(spark, raw, tmp_path):
    source = str(tmp_path / "raw")
    root = str(tmp_path / "store")
    for number in range(3):
        frame = raw(*[raw_row(number * 10 + i, f"u{i + number}") for i in range(5)])
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        ingest_stream(stream, lambda b: b, root, str(tmp_path / "cp"), embedder=EMBED).awaitTermination()
    assert tables.read_listings(spark, root).count() == 7
    runs = tables.read_runs(spark, root)
    assert runs.count() == 3
    assert runs.agg(F.sum("stored"), F.sum("skipped_dedup")).first()[:] == (7, 8)


def test_all_sources(spark, tmp_path):
    posting = json.dumps({"@type": "JobPosting", "title": "Software Engineer", "description": GOOD,
                          "hiringOrganization": {"name": "E"}})
    page = f'<script type="application/ld+json">{posting}</script>'
    feed = json.dumps({"jobs": [{"title": "Software Engineer", "content": GOOD, "absolute_url": "g1"}]})
    card = "<div class=job_seen_beacon><h2><a href='/v'><span>Python Dev</span></a></h2><span class=companyName>C</span></div>"
    rows = [
        ("greenhouse", "feed", "acme", "https://g", feed), ("cutshort", "page", None, "https://c/1", page),
        ("indeed", "search", None, "https://in.indeed.com/jobs", card + card),
        ("indeed", "page", None, "https://in.indeed.com/v", "<div id=jobDescriptionText><p>Python software"),
    ]
    captures = spark.createDataFrame(
        [(*r, 1, i) for i, r in enumerate(rows)],
        "source string, kind string, board string, url string, body string, page int, seq long",
    )
    raw, fetched = raw_listings(captures, "software engineer", ["greenhouse", "cutshort", "indeed", "lever"])
    log = log_of(ingest_batch(raw, str(tmp_path / "store"), "r", fetched=fetched, embedder=EMBED))
    assert {name: (log[name]["fetched"], log[name]["stored"]) for name in log} == {
        "greenhouse": (1, 1), "cutshort": (1, 1), "indeed": (2, 1), "lever": (0, 0),
    }
    with pytest.raises(ValueError):
        raw_listings(captures, "x", ["nowhere"])


def test_run_log_rows(spark):
    events = spark.createDataFrame(
        [("r", "s", "fetched", ""), ("r", "s", "error", "e1"), ("r", "s", "stored", ""), ("r", "t", "skipped_dedup", "")],
        "run_id string, source string, outcome string, text string",
    )
    log = log_of(run_counters(events, F.col("outcome")))
    assert (log["s"]["fetched"], log["s"]["stored"], log["s"]["error_count"], log["t"]["skipped_dedup"]) == (1, 1, 1, 1)
    assert run_errors(events, F.col("outcome"), F.col("text")).first()["error"] == "e1"
    runs = spark.createDataFrame(
        [("r", "s", 1, 10), ("r", "s", 2, 20), ("r", "t", 3, 15)], "run_id string, source string, stored int, written_at int"
    )
    assert [r["stored"] for r in latest_run(runs).collect()] == [2]
    assert sorted(r["stored"] for r in latest_run(runs, ("run_id", "source")).collect()) == [2, 3]


def test_first_arrival_of_a_second_run_is_stored(spark, raw, tmp_path):
    root = str(tmp_path / "store")
    ingest_batch(raw(raw_row(1, "a"), raw_row(2, "b")), root, "run1", embedder=EMBED)
    frame = raw(raw_row(5, "c", title="late"), raw_row(4, "c", title="early"), raw_row(3, "a"), raw_row(6, "d", WEAK))
    log = log_of(ingest_batch(frame, root, "run2", embedder=EMBED))["s"]
    assert (log["stored"], log["skipped_dedup"], log["skipped_low_confidence"]) == (1, 2, 1)
    stored = {r["url"]: r["title"] for r in tables.read_listings(spark, root).collect()}
    assert stored == {"a": "T", "b": "T", "c": "early"}


def test_search_record_before_with_and_after_its_page(spark, tmp_path):
    card = "<div class=job_seen_beacon><h2><a href='/{0}'><span>Python {0}</span></a></h2><span class=companyName>C</span></div>"
    text = "<div id=jobDescriptionText><p>Python software"

    def search(name):
        return ("indeed", "search", "https://in.indeed.com/jobs", card.format(name))

    def page(name):
        return ("indeed", "page", f"https://in.indeed.com/{name}", text)

    steps = [[search("before"), page("after")], [page("before"), search("with"), page("with")], [search("after"), page("never")]]
    root, source, checkpoint = (str(tmp_path / n) for n in ("store", "captures", "cp"))
    seen = []
    for number, step in enumerate(steps):
        rows = [(s, k, None, u, b, 1, number * 10 + i, None) for i, (s, k, u, b) in enumerate(step)]
        spark.createDataFrame(rows, tables.CAPTURE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = tables.read_captures_stream(spark, source)
        ingest_captures_stream(stream, "software engineer", root, checkpoint, ["indeed"], embedder=EMBED).awaitTermination()
        seen.append(sorted(r["title"] for r in tables.read_listings(spark, root).collect()))
    assert seen == [[], ["Python before", "Python with"], ["Python after", "Python before", "Python with"]]
    log = tables.read_runs(spark, root).agg(F.sum("fetched"), F.sum("stored")).first()
    assert log[:] == (3, 3)
