import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from joblattice.functions import jsonld
from joblattice.sources import pages

ROLE = "software engineer"


@pytest.fixture
def page(spark):
    def build(source, *bodies, url="https://www.example.com/jobs/1"):
        rows = [(source, "page", url, body, i) for i, body in enumerate(bodies)]
        return spark.createDataFrame(rows, "source string, kind string, url string, body string, seq long")

    return build


@pytest.fixture
def records(spark):
    schema = (
        "source string, url string, title string, company string, location string, "
        "posted_at string, description string, seq long, pos int"
    )
    return lambda *rows: spark.createDataFrame(list(rows), schema)


def ld(*objects):
    return "".join(
        f'<script type="application/ld+json">{o if isinstance(o, str) else json.dumps(o)}</script>'
        for o in objects
    )


def rows_of(frame):
    return [row.asDict() for row in frame.orderBy("seq").collect()]


POSTING = {
    "@type": "JobPosting", "title": "Crane Software Operator Engineer",
    "description": "<p>Move <i>containers</i> with Rust.</p>",
    "hiringOrganization": {"name": "Harbour"},
    "jobLocation": {"address": {"addressLocality": "Bergen"}}, "datePosted": "2021-03-04",
}


def test_json_ld_blocks(spark):
    html = (
        "<!-- " + ld({"@type": "JobPosting", "title": "hidden"}) + " -->"
        + "<script>var x='<script type=\"application/ld+json\">{}';</script>"
        + ld("{bad", [{"@type": "A"}, 3, {"@type": "B"}], "7", '{"a": 1} tail', {"@type": "JobPosting", "title": "t"})
        + "<SCRIPT id=x TYPE='application/ld+json'>{\"@type\":\"C\",\"@type\":\"D\"}</SCRIPT>"
    )
    frame = spark.createDataFrame([(html,)], "body string").repartition(2)
    blocks = jsonld.json_ld_blocks(jsonld.json_ld_scripts(F.col("body")))
    types = frame.select(F.transform(blocks, lambda b: jsonld.field(b, '$["@type"]'))).first()[0]
    assert types == ["A", "B", "JobPosting", "D"]
    posting = jsonld.job_posting(blocks)
    assert frame.select(jsonld.field(posting, "$.title")).first()[0] == "t"


@pytest.mark.parametrize(
    "value, expected",
    [
        ({"address": {"addressLocality": "Pune"}}, "Pune"),
        ({"address": {"addressLocality": "", "streetAddress": "MG Road"}}, "MG Road"),
        ({"address": {"addressRegion": "KA"}}, "KA"),
        ({"address": [{"addressLocality": "lost"}, {"address": {"addressLocality": "kept"}}]}, "kept"),
        ([{"address": {"addressLocality": "A"}}, {}, {"address": {"addressRegion": "B"}}], "A, B"),
        ([[{"address": {"addressLocality": "deep"}}]], "deep"),
        ({"address": [{"address": [{"address": {"addressLocality": "deeper"}}]}]}, "deeper"),
        ({"address": "text"}, ""), ("text", ""), (None, ""), ({}, ""),
    ],
)
def test_extract_location(spark, value, expected):
    frame = spark.createDataFrame([(json.dumps(value),)], "j string").repartition(2)
    assert frame.select(jsonld.extract_location(F.try_parse_json("j"))).first()[0] == expected


@pytest.mark.parametrize(
    "value, expected",
    [({"name": "Acme"}, "Acme"), ([{"name": ""}, "Beta", {"name": "C"}], "Beta"), ("Plain", "Plain"),
     ([[{"name": ""}, {"name": "Inner"}]], "Inner"),
     (None, ""), ({}, ""), ([], "")],
)
def test_extract_company(spark, value, expected):
    frame = spark.createDataFrame([(json.dumps(value),)], "j string").repartition(2)
    assert frame.select(jsonld.extract_company(F.try_parse_json("j"))).first()[0] == expected


def test_webpage_date(spark):
    blocks = [
        {"@graph": "no list"}, {"@graph": [{"@type": "WebPage"}, {"@type": "WebPage", "datePublished": "late"}]},
        {"@graph": [3, {"@type": "Person"}, {"@type": "WebPage", "datePublished": "2026"}]},
    ]
    frame = spark.createDataFrame([(ld(*blocks),)], "body string").repartition(2)
    found = jsonld.webpage_date(jsonld.json_ld_blocks(jsonld.json_ld_scripts(F.col("body"))))
    assert frame.select(found).first()[0] == "2026"


def test_cutshort(page):
    html = "<h1>  Software Engineer, <b>x</b></h1><h2>at Acme</h2>"
    rows = rows_of(pages.page_cutshort(page("cutshort", ld(POSTING), html, "<h1>Chef</h1>"), ROLE))
    assert [r["fetched"] for r in rows] == [1, 1, 1] and [r["matched"] for r in rows] == [True, True, False]
    assert rows[0]["company"] == "Harbour" and rows[0]["location"] == "Bergen"
    assert rows[0]["description"] == "Move containers with Rust." and rows[0]["posted_at"] == "2021-03-04"
    assert rows[1]["title"] == "Software Engineer" and rows[1]["company"] == "Acme"
    assert rows[1]["location"] == "India" and rows[1]["description"] == ""


def test_foundit(page):
    html = (
        "<h1>Software Engineer</h1><h2>Other</h2><span data-testid='company-name'> Acme  Ltd </span>"
        "<div data-testid='job-location'>Pune</div>"
    )
    rows = rows_of(pages.page_foundit(page("foundit", html, "<h1>Chef</h1>"), ROLE))
    assert len(rows) == 1 and rows[0]["fetched"] == 1
    assert (rows[0]["company"], rows[0]["location"]) == ("Acme Ltd", "Pune")


def test_foundit_demo(page, records):
    found = records(
        ("foundit_demo", "https://www.example.com/jobs/1", "Software Engineer", "Second", "X", None, "y", 2, 0),
        ("foundit_demo", "https://www.example.com/jobs/1", "Software Engineer", "First", "Pune", "5", "found", 1, 0),
    )
    rows = rows_of(pages.page_foundit_demo(page("foundit_demo", "<p>none</p>", ld(POSTING)), found, ROLE))
    assert [r["company"] for r in rows] == ["First", "Harbour"] and [r["fetched"] for r in rows] == [0, 0]
    assert rows[0]["description"] == "found" and rows[0]["posted_at"] == "5" and rows[0]["location"] == "Pune"


def test_forage_ai(page):
    long = "word " * 30
    wrapped = f"<h1>Software Engineer</h1><div class='content-wrapper'>{long}<style>no</style><p>end</p></div>"
    prose = f"<main><h1>Software Engineer</h1><p>{long}</p><li>item</li></main><i class='job-location'>Pune</i>"
    graph = ld({"@graph": [{"@type": "WebPage", "datePublished": "2026"}]})
    rows = rows_of(pages.page_forage_ai(page("forage_ai", wrapped + graph, prose, "<h1>Software Engineer</h1><p>x"), ROLE))
    assert len(rows) == 2
    assert rows[0]["description"] == long.strip() + " end" and rows[0]["posted_at"] == "2026"
    assert rows[0]["location"] == "Remote" and rows[0]["company"] == "Forage AI"
    assert rows[1]["description"] == long.strip() + " item" and rows[1]["location"] == "Pune"


def test_greenhouse_rendered(page):
    html = "<div class=job__title>Software Engineer</div><div id=content>a<p>b <i>c</i></p></div><p class='x location'>Pune</p>"
    rows = rows_of(pages.page_greenhouse_rendered(page("greenhouse_playwright", ld(POSTING), html), ROLE))
    assert (rows[0]["company"], rows[0]["location"]) == ("Harbour", "Bergen")
    assert (rows[1]["description"], rows[1]["location"], rows[1]["company"]) == ("b c", "Pune", "")


def test_indeed_and_ddg(page, records):
    url = "https://www.example.com:8080/jobs/1"
    found = records(("indeed", url, "Chef", "Acme", "", "3d", "", 0, 0))
    html = "<title> Page </title><body>top<div id=jobDescriptionText>x<p>cook <b>food</b></p></div><script>js</script>"
    rows = rows_of(pages.page_indeed(page("indeed", html, url=url), found))
    assert rows[0]["title"] == "Chef" and rows[0]["description"] == "cook food" and rows[0]["posted_at"] == "3d"
    rows = rows_of(pages.page_ddg(page("ddg", html, url=url), found))
    assert rows[0]["title"] == "Page" and rows[0]["company"] == "www.example.com:8080"
    assert rows[0]["description"] == "x cook food js" and rows[0]["location"] == "Unknown"
    rows = rows_of(pages.page_ddg(page("ddg", "<body><p>" + "a" * 5000, url=url), found))
    assert len(rows[0]["description"]) == 4000


def test_hot_page_is_cut_into_slices(spark, records):
    rows = [("x", "hot" if i % 3 else f"u{i % 10}", i) for i in range(900)]
    frame = spark.createDataFrame(rows, "source string, url string, seq long")
    found = records(*[("x", u, f"T-{u}", "", "", None, "", 0, 0) for u in ("hot", "u0", "u3", "u6", "gone")])
    joined = pages.attach_search_record(frame, found, rows_per_slice=50)
    names = {"hot", "u0", "u3", "u6"}
    expected = sorted((i, f"T-{u}" if u in names else None) for _, u, i in rows)
    got = sorted(((r["seq"], r["found_title"]) for r in joined.collect()), key=lambda p: p[0])
    assert got == expected


def test_batches_for_python_are_bounded_by_bytes(spark):
    """Few long pages and many short ones fill the same memory."""

    @F.pandas_udf("long")
    def in_batch(html: pd.Series) -> pd.Series:
        return pd.Series([int(html.str.len().sum())] * len(html))

    pages_ = spark.range(300, numPartitions=1).select(F.repeat(F.lit("x"), 50_000).alias("html"))
    most = pages_.select(in_batch("html").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 5_000_000
