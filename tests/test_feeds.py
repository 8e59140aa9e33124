import json

import pytest

from joblattice.sources import feeds


@pytest.fixture
def captures(spark):
    def build(source, bodies, board="acme-corp", kind="feed", url="https://api.example.com/x"):
        rows = [
            (source, kind, board, url, body if isinstance(body, str) else json.dumps(body), 1, i)
            for i, body in enumerate(bodies)
        ]
        schema = "source string, kind string, board string, url string, body string, page int, seq long"
        return spark.createDataFrame(rows, schema)

    return build


def collected(frame):
    return [row.asDict() for row in frame.orderBy("seq", "pos").collect()]


def test_greenhouse(captures):
    ferry = {"title": "Ferry Scheduling Planner", "company_name": "Nordlicht Line", "absolute_url": "https://jobs.nordlicht.test/4711",
             "content": "&lt;ul&gt;&lt;li&gt;Tides &amp; timetables&lt;/li&gt;&lt;/ul&gt;", "location": {"name": "Kiel"}, "updated_at": "2025-11-30T08:00:00Z"}
    night = {"title": "planner (ferry, nights)", "content": "dark", "location": None, "first_published": "in March", "updated_at": "in May"}
    other = {"title": "Harbour Cook", "content": "for the ferry planner"}
    rows = collected(feeds.feed_greenhouse(captures("greenhouse", [{"jobs": [ferry, night, other]}, "{bad", "[]"]), "ferry planner"))
    assert [r["title"] for r in rows] == [ferry["title"], night["title"]]
    assert [r["company"] for r in rows] == ["Nordlicht Line", "Acme Corp"] and [r["location"] for r in rows] == ["Kiel", "Unknown"]
    assert rows[0]["description"] == "Tides & timetables" and [r["url"] for r in rows] == [ferry["absolute_url"], ""]
    assert [r["posted_at"] for r in rows] == ["2025-11-30T08:00:00Z", "in March"]


def test_lever(captures):
    moment = 1_700_000_000_250  # 2023-11-14 22:13:20.250
    tuner = {"text": "Organ Tuner", "openingPlain": "Pipes.", "descriptionPlain": "Reeds and flues", "createdAt": moment,
             "lists": [{"content": "<p>Climb <i>ladders</i></p>"}, {}, {"content": "Travel"}], "categories": {"location": "Passau"},
             "additionalPlain": "No heights, no job"}
    silent = {"text": "organ tuner's mate", "additionalPlain": "holds the key", "createdAt": "whenever"}
    first, second = collected(feeds.feed_lever(captures("lever", [[tuner, silent]]), "organ tuner"))
    assert first["description"] == "Pipes. Reeds and flues Climb ladders Travel No heights, no job"
    assert (first["posted_at"], first["location"]) == ("2023-11-14T22:13:20.250000+00:00", "Passau")
    assert (second["description"], second["posted_at"], second["location"]) == ("holds the key", "whenever", "Unknown")


def test_arbeitnow(captures):
    base = {"title": "Software Engineer", "description": "&lt;p&gt;x&lt;/p&gt;", "company_name": "A", "url": "u"}
    body = {"data": [
        {**base, "remote": True, "created_at": 1767225600}, {**base, "remote": False, "location": ""},
        {**base, "remote": True, "location": "Berlin"},
    ]}
    rows = collected(feeds.feed_arbeitnow(captures("arbeitnow", [body]), "software engineer"))
    assert [r["location"] for r in rows] == ["Remote", "Unknown", "Berlin"]
    assert rows[0]["posted_at"] == "2026-01-01T00:00:00+00:00" and rows[0]["description"] == "x"
    assert all(r["fetched"] == 1 and r["matched"] for r in rows)


def test_ashby(captures):
    base = {"title": "Software Engineer", "descriptionPlain": "plain", "applyUrl": "apply"}
    body = {"jobs": [
        {**base, "isRemote": True, "location": "Pune"}, {**base, "isRemote": True, "location": "Remote - EU"},
        {**base, "isRemote": True}, {**base, "descriptionHtml": "<b>html</b>", "jobUrl": "job", "publishedAt": "2026"},
    ]}
    rows = collected(feeds.feed_ashby(captures("ashby", [body]), "software engineer"))
    assert [r["location"] for r in rows] == ["Pune, Remote", "Remote - EU", "Remote", "Unknown"]
    assert rows[3]["description"] == "html" and rows[3]["url"] == "job" and rows[3]["posted_at"] == "2026"
    assert rows[0]["description"] == "plain" and rows[0]["url"] == "apply" and rows[0]["company"] == "Acme Corp"


def test_himalayas(captures):
    base = {"title": "Software Engineer", "description": "d", "companyName": "H", "guid": "g"}
    body = {"jobs": [{**base, "locationRestrictions": ["India", "US"], "pubDate": 1767225600}, base]}
    rows = collected(feeds.feed_himalayas(captures("himalayas", [body]), "software engineer"))
    assert [r["location"] for r in rows] == ["India, US", "Remote"]
    assert rows[0]["url"] == "g" and rows[0]["posted_at"] == "2026-01-01T00:00:00+00:00"


def test_foundit_search(captures):
    base = {"title": "Software Engineer", "companyName": "F", "locations": "Pune", "id": 7}
    body = {"jobSearchResponse": {"data": [
        {**base, "seoJdUrl": "/job/se-7", "jobDescription": "jd", "updatedAt": 5},
        {**base, "summary": "sum", "postedAt": "p"}, {**base, "type": "ad"}, {**base, "title": "Chef"},
    ]}}
    frame = feeds.feed_foundit_search(captures("foundit_demo", [body], url="https://www.foundit.in/m/s?q=1"), "software engineer")
    rows = collected(frame)
    assert [r["url"] for r in rows] == [
        "https://www.foundit.in/job/se-7", "https://www.foundit.in/job/software-engineer-7",
    ]
    assert [r["description"] for r in rows] == ["jd", "sum"] and [r["posted_at"] for r in rows] == ["5", "p"]
