import pytest

from joblattice.sources import frontier as f


@pytest.fixture
def captures(spark):
    def build(source, kind, *bodies, url="https://www.example.com/a/b", page=1):
        rows = [(source, kind, None, url, body, page, i) for i, body in enumerate(bodies)]
        schema = "source string, kind string, board string, url string, body string, page int, seq long"
        return spark.createDataFrame(rows, schema)

    return build


def sitemap(*urls, ns=""):
    prefix = f"{ns}:" if ns else ""
    locs = "".join(f"<{prefix}url><{prefix}loc>{u}</{prefix}loc></{prefix}url>" for u in urls)
    return f"<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>{locs}</urlset>"


def urls(frame):
    return [row["url"] for row in frame.orderBy("seq", "pos").collect()]


def test_sitemap_urls(captures):
    body = sitemap("https://a.com/1?x=1&amp;y=2", "<![CDATA[https://a.com/2]]>", "\n https://a.com/3 ")
    broken = "<urlset><url><loc>https://a.com/4</loc><!-- <loc>no</loc> --><loc>"
    found = urls(f.sitemap_urls(captures("x", "sitemap", body, sitemap("https://a.com/5", ns="sm"), broken)))
    assert found == ["https://a.com/1?x=1&y=2", "https://a.com/2", "https://a.com/3", "https://a.com/5", "https://a.com/4"]
    body = sitemap("https://a.com/?a&#x26;b&#38;c&#233;&#8364;", "<![CDATA[https://a.com/?a&amp;b]]>", "https://a.com/?q=&amp;lt;")
    assert urls(f.sitemap_urls(captures("x", "sitemap", body))) == [
        "https://a.com/?a&b&cé€", "https://a.com/?a&amp;b", "https://a.com/?q=&lt;"]


def test_sitemap_frontiers(captures):
    jobs = [f"https://a.com/software-engineer-{i // 2}" for i in range(80)]
    body = sitemap("https://a.com/chef", *jobs)
    kept = urls(f.cutshort_frontier(captures("cutshort", "sitemap", body, body), "software engineer"))
    assert kept == [f"https://a.com/software-engineer-{i}" for i in range(30)] * 2
    kept = urls(f.foundit_frontier(captures("foundit", "sitemap", body), "software engineer"))
    assert kept == jobs[:30]
    pages = [f"https://f.ai/job-opportunities/{i}" for i in range(40)]
    body = sitemap(*pages, "https://f.ai/about")
    assert urls(f.forage_frontier(captures("forage_ai", "sitemap", body))) == pages[::-1][:30]
    assert f.sitemap_cap(0) == 10


def test_page_plans(spark, captures):
    roles = spark.createDataFrame([("data engineer",)], "role string")
    found = [r["url"] for r in f.indeed_pages(roles).orderBy("page").collect()]
    assert found[1] == "https://in.indeed.com/jobs?q=data+engineer&l=India&fromage=7&start=10" and len(found) == 3
    assert f.ddg_search(roles).first()["url"].startswith(
        "https://duckduckgo.com/html/?q=site%3Alinkedin.com%2Fjobs+OR+site%3Acutshort.io+data"
    )
    state = 'var _seoHtmlProps_ = {"limit": 15, "query": "qa"};'
    plan = f.foundit_pages(captures("foundit_demo", "search", state, "nothing", "var _seoHtmlProps_ = {};"), "r")
    assert [(r["start"], r["seq"]) for r in plan.orderBy("start").collect()] == [(0, 0), (15, 0), (30, 0)]
    assert plan.orderBy("start").first()["url"].endswith("?query=qa&locations=India&start=0&limit=15")
    plan = f.foundit_pages(captures("foundit_demo", "search", 'var _seoHtmlProps_ = {"other": 1};'), "r")
    assert [r["start"] for r in plan.orderBy("start").collect()] == [0, 25, 50]
    assert plan.orderBy("start").first()["url"].endswith("?query=r&locations=India&start=0&limit=25")


def test_next_pages(captures):
    body = '{"totalCount": 45, "jobs": []}'
    assert [r["url"] for r in f.himalayas_next(captures("himalayas", "feed", body, "{}", page=1)).collect()] == [
        "https://himalayas.app/jobs/api?limit=20&offset=40"
    ]
    assert f.himalayas_next(captures("himalayas", "feed", body, page=2)).count() == 0
    body = '{"links": {"next": "https://n"}}'
    assert [r["url"] for r in f.arbeitnow_next(captures("arbeitnow", "feed", body, "{}", page=2)).collect()] == ["https://n"]
    assert f.arbeitnow_next(captures("arbeitnow", "feed", body, page=3)).count() == 0


def test_boards(spark):
    requests = spark.createDataFrame([("a, b",), (None,)], "boards string")
    found = [r["url"] for r in f.board_frontier(requests, "greenhouse").orderBy("board").collect()]
    assert found[0] == "https://boards-api.greenhouse.io/v1/boards/a/jobs?content=true"
    assert [u.split("/")[5] for u in found] == ["a", "airbnb", "b", "stripe"]


def test_links(captures):
    board = (
        "<a href='/co/jobs/1'><p>Software</p> <p>Engineer</p></a><a href='/co/jobs/1'>Software Engineer again</a>"
        "<a href='/co/jobs/2'>Chef</a><a href='/about'>Software Engineer</a>"
    )
    found = urls(f.board_link_frontier(captures("greenhouse_playwright", "board", board), "software engineer"))
    assert found == ["https://www.example.com/co/jobs/1"]

    results = "<a class='result__a x' href='https://x.com/1'> T1 <b>b</b></a><a class='result__a'>none</a>"
    frame = f.result_link_frontier(captures("ddg", "search", results))
    assert [(r["url"], r["title"]) for r in f.search_records(frame).collect()] == [("https://x.com/1", "T1")]
    assert f.fetched_counts(frame).first()["fetched"] == 2

    card = (
        "<div class='job_seen_beacon'><h2><a href='/v?1'><span>T1</span></a></h2><span class=companyName>C</span>"
        "<div class=companyLocation>L</div><span class=date> </span></div><div class='job_seen_beacon'></div>"
    )
    frame = f.card_frontier(captures("indeed", "search", card, card + "Security Check - Indeed.com"))
    row = f.search_records(frame).first()
    assert (row["url"], row["title"], row["company"], row["location"], row["posted_at"]) == (
        "https://www.example.com/v?1", "T1", "C", "L", None,
    )
    assert f.fetched_counts(frame).first()["fetched"] == 2
