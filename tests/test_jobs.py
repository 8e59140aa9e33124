import json

from joblattice import jobs
from joblattice.plans.ingest import insert_if_absent
from joblattice.schema import CAPTURE_SCHEMA, LISTING_SCHEMA
from joblattice.sources.store import read_captures, read_listings, read_runs

GOOD = "Python engineer services"


def captures(spark, path):
    jobs_of = {"jobs": [{"title": f"Software Engineer {i}", "content": f"<p>{GOOD}</p>", "absolute_url": f"g{i}"} for i in range(3)]}
    card = "<div class=job_seen_beacon><h2><a href='/v'><span>Python Dev</span></a></h2><span class=companyName>C</span></div>"
    batches = [
        [("greenhouse", "feed", "acme-inc", "https://g", json.dumps(jobs_of)), ("indeed", "search", None, "https://in.indeed.com/jobs", card)],
        [("indeed", "page", None, "https://in.indeed.com/v", "<div id=jobDescriptionText><p>Python software")],
    ]
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(
            [(*row, 1, number * 10 + i, None) for i, row in enumerate(rows)], CAPTURE_SCHEMA
        )
        frame.coalesce(1).write.mode("append").parquet(path)
    assert read_captures(spark, path).count() == 3


def said(capsys):
    lines = capsys.readouterr().out.splitlines()
    return [json.loads(line) for line in lines if line.startswith("{")]


def test_ingest_query_stats(spark, tmp_path, capsys):
    path, store = str(tmp_path / "captures"), str(tmp_path / "store")
    captures(spark, path)
    base = ["--store", store, "--dims", "64"]
    ingest = ["ingest", "--captures", path, "--role", "software engineer", "--sources", "greenhouse", "indeed", "lever"]
    jobs.main([*base, *ingest, "--run-id", "r1"])
    out = said(capsys)
    logs = {line["source"]: line for line in out if "stored" in line}
    assert {s: (logs[s]["fetched"], logs[s]["stored"]) for s in logs} == {
        "greenhouse": (3, 3), "indeed": (1, 1), "lever": (0, 0),
    }
    assert out[-1] == {"run_id": "r1", "status": "completed", "sources": ["greenhouse", "indeed", "lever"]}

    jobs.main([*base, "query", "--q", "software engineer acme"])
    answer = said(capsys)[0]
    assert answer["answer"].startswith("Based on the indexed listings: ") and len(answer["sources"]) == 4

    jobs.main([*base, "stats"])
    out = said(capsys)
    assert out[0]["total_listings"] == 4 and out[0]["by_source"] == {"greenhouse": 3, "indeed": 1}
    assert out[0]["top_skills"][0] == {"skill": "Python", "count": 4} and len(out) == 1
    assert [(r["run_id"], r["source"], r["stored"]) for r in out[0]["last_runs"]] == [
        ("r1", "greenhouse", 3), ("r1", "indeed", 1), ("r1", "lever", 0)]


def test_stream_finds_the_search_record_of_an_earlier_batch(spark, tmp_path):
    path, store = str(tmp_path / "captures"), str(tmp_path / "store")
    captures(spark, path)
    ingest = ["ingest", "--captures", path, "--role", "software engineer", "--sources", "greenhouse", "indeed"]
    jobs.main(["--store", store, "--dims", "16", *ingest, "--checkpoint", str(tmp_path / "cp")])
    stored = {r["url"]: r["title"] for r in read_listings(spark, store).collect()}
    assert len(stored) == 4 and stored["https://in.indeed.com/v"] == "Python Dev"
    assert {r["source"] for r in read_runs(spark, store).collect()} == {"greenhouse", "indeed"}


def test_insert_if_absent(spark, tmp_path):
    from datetime import datetime

    def listing(key, day):
        return (key, "AI Engineer", "Acme", f"https://e.com/{key}", "Python LLM systems", "Remote", "ddg", None,
                ["Python"], 0.9, [0.1, 0.2, 0.3], datetime(2026, 1, day))

    store = str(tmp_path / "store")
    rows = spark.createDataFrame([listing("a", 2), listing("a", 1), listing("b", 1)], LISTING_SCHEMA)
    assert {r["id"]: r["inserted"] for r in insert_if_absent(rows, store, "one").collect()} == {"a": True, "b": True}
    rows = spark.createDataFrame([listing("a", 3), listing("c", 1)], LISTING_SCHEMA)
    assert {r["id"]: r["inserted"] for r in insert_if_absent(rows, store, "two").collect()} == {"a": False, "c": True}
    kept = {r["id"]: r["ingested_at"].day for r in read_listings(spark, store).collect()}
    assert kept == {"a": 1, "b": 1, "c": 1}
