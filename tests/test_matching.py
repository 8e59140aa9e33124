"""Pages and search records of a stream, matched as keyed state."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from joblattice.plans.ingest import default_embedder
from joblattice.sources import store as tables
from joblattice.streaming import matching
from joblattice.streaming.ingest import ingest_captures_stream, session_conf

AT_ONCE = {"wait": timedelta(0), "clock_skew": timedelta(milliseconds=1)}
CARD = "<div class=job_seen_beacon><h2><a href='/{0}'><span>{1}</span></a></h2><span class=companyName>C</span></div>"
TEXT = "<div id=jobDescriptionText><p>Python {0}"


def search(*cards):
    return ("indeed", "search", "https://in.indeed.com/jobs", "".join(CARD.format(*c) for c in cards))


def page(name, text="x"):
    return ("indeed", "page", None if name is None else f"https://in.indeed.com/{name}", TEXT.format(text))


@pytest.fixture
def run(spark, tmp_path):
    """Matches one more step of captures per call; returns all rows so far."""
    state = {"seq": 0}

    def step(*captures, **options):
        rows = []
        for source, kind, url, body in captures:
            state["seq"] += 1
            rows.append((source, kind, None, url, body, 1, state["seq"], None))
        spark.createDataFrame(rows, tables.CAPTURE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "captures"))
        stream = tables.read_captures_stream(spark, str(tmp_path / "captures"))
        with session_conf(spark, matching.STATE_CONF):
            matching.matched(stream, "engineer", ["indeed", "foundit_demo"], **options).writeStream.format("parquet").option(
                "path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(matching.MATCHED).parquet(str(tmp_path / "rows"))

    return step


def pages(rows):
    return sorted(((r["url"] or "")[-1:], r["text"], r["found_title"]) for r in rows.filter("part = 'page'").collect())


def test_first_record_of_a_page_counts(run):
    found = run(search(("a", "first"), ("a", "second")), search(("a", "third")), page("a", 1), page("b", 2))
    assert pages(found) == [("a", "Python 1", "first")]
    # a record with a later number doesn't replace the first; a page waits as long as it takes
    found = run(page("a", 3), search(("a", "fourth"), ("b", "late")))
    assert pages(found) == [("a", "Python 1", "first"), ("a", "Python 3", "first"), ("b", "Python 2", "late")]
    assert found.agg(F.sum("fetched")).first()[0] == 5


def test_many_captures_of_one_page(run):
    found = run(*[page("a", i) for i in range(300)])
    assert pages(found) == []
    found = run(search(("a", "here")), *[page("a", i) for i in range(300, 320)])
    assert pages(found) == sorted(("a", f"Python {i}", "here") for i in range(320))


def test_rows_without_an_address(run):
    found = run(page(None, 1), ("indeed", "search", "https://in.indeed.com/jobs", "<div class=job_seen_beacon>no link</div>"))
    assert pages(found) == [("", "Python 1", None)]
    assert found.agg(F.sum("fetched")).first()[0] == 1


def test_waiting_ends(run):
    posting = json.dumps({"@type": "JobPosting", "title": "Engineer", "hiringOrganization": {"name": "Own"}})
    alone = ("foundit_demo", "page", "https://x/p", f'<script type="application/ld+json">{posting}</script>')
    assert pages(run(alone, **AT_ONCE)) == []
    found = run(search(("z", "other")), **AT_ONCE)  # a later micro-batch: the page has waited
    assert [(r["ld_title"], r["ld_company"], r["found_title"]) for r in found.filter("part = 'page'").collect()] == [("Engineer", "Own", None)]
    # the record of that step is forgotten in the next but one
    run(page("q"), **AT_ONCE)
    assert pages(run(page("z"), search(("w", "w")), **AT_ONCE))[0][2] is None
    assert ("z", "Python x", "other") not in pages(run(search(("v", "v")), **AT_ONCE))


def test_sources_of_all_kinds_in_one_stream(spark, tmp_path):
    feed = json.dumps({"jobs": [{"title": "Software Engineer", "content": "Python services", "absolute_url": "g1"}]})
    steps = [
        [("greenhouse", "feed", "https://g", feed), page("a"), ("lever", "feed", "https://l", "no json"), ("other", "feed", "u", "x")],
        [search(("a", "Dev"), ("b", "Ops")), ("ddg", "search", "https://d", "ignored")],
    ]
    root, path, seq = str(tmp_path / "store"), str(tmp_path / "captures"), 0
    for step in steps:
        rows = [(s, k, "acme", u, b, 1, seq + i, None) for i, (s, k, u, b) in enumerate(step)]
        seq += len(step)
        tables.write_captures(spark.createDataFrame(rows, tables.CAPTURE_SCHEMA), path)
        before = {k: spark.conf.get(k, None) for k in matching.STATE_CONF}
        ingest_captures_stream(
            tables.read_captures_stream(spark, path), "software engineer", root, str(tmp_path / "cp"), ["greenhouse", "lever", "indeed"],
            embedder=default_embedder(8)).awaitTermination()
        assert {k: spark.conf.get(k, None) for k in matching.STATE_CONF} == before
    assert sorted(r["title"] for r in tables.read_listings(spark, root).collect()) == ["Dev", "Software Engineer"]
    log = tables.read_runs(spark, root).groupBy("source").agg(F.sum("fetched"), F.sum("stored")).collect()
    assert {r[0]: (r[1], r[2]) for r in log} == {"greenhouse": (1, 1), "lever": (0, 0), "indeed": (2, 1)}
