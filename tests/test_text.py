import hashlib
import html
import re
from datetime import UTC, datetime
from urllib.parse import urlencode, urljoin

from pyspark.sql import functions as F

from joblattice.functions import text as t
from joblattice.functions.html import absolute_url, clean_html_text


def values(spark, column, rows, schema="a string"):
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [row[0] for row in frame.coalesce(1).select(column).collect()]


def test_collapse_ws_like_split(spark):
    samples = ["  Bengaluru   India ", "a b c", "\x1cx\x1f\ty ", "", " 　 "]
    expected = [" ".join(s.split()) for s in samples]
    assert values(spark, t.collapse_ws(F.col("a")), samples) == expected
    assert values(spark, t.strip_ws(F.col("a")), samples) == [s.strip() for s in samples]


def test_matches_role(spark):
    titles = [
        "Senior Software Engineer", "platform software role for engineer", "data analyst",
        "Product Manager", "software-engineering lead", "", None,
    ]
    expected = [True, True, False, False, True, False, False]
    assert values(spark, t.matches_role(F.col("a"), "software engineer"), titles) == expected
    assert values(spark, t.matches_role(F.col("a"), ""), ["x"]) == [False]
    assert values(spark, t.matches_role(F.col("a"), "C"), ["c dev", "go"]) == [True, False]


def test_clean_html_text(spark):
    samples = [
        "<p>Hello <strong>World</strong></p>", "&lt;b&gt;x&lt;/b&gt; &amp;amp; y", None,
        "caf&eacute;&nbsp;bar &copy 2024 &#8364;", "a < b and c > d",
    ]
    def clean(s):
        return " ".join(re.sub(r"<[^>]+>", " ", html.unescape(s or "")).split())

    assert values(spark, clean_html_text(F.col("a")), samples) == [clean(s) for s in samples]
    assert clean(samples[0]) == "Hello World"


def test_listing_id(spark):
    rows = [("indeed", "https://example.com/jobs/1"), ("indeed", None)]
    expected = [hashlib.sha256(f"{s}:{u or ''}".encode()).hexdigest() for s, u in rows]
    found = values(spark, t.listing_id(F.col("a"), F.col("b")), rows, "a string, b string")
    assert found == expected


def test_epoch_to_iso(spark):
    def iso(x):
        x = float(x)
        return datetime.fromtimestamp(x / 1000 if x > 1e10 else x, tz=UTC).isoformat()

    numbers = ["1767225600000", "1767225600", "1700000000.25", "0", "-86400.5", "1.7e9", "1700000000123"]
    assert values(spark, t.epoch_to_iso(F.col("a")), numbers) == [iso(x) for x in numbers]
    others = ["2026-01-01", "", None, "nan", "9e20", "1d"]
    assert values(spark, t.epoch_to_iso(F.col("a")), others) == [
        "2026-01-01", None, None, "nan", "9e20", "1d",
    ]


def test_comma_values_and_titles(spark):
    assert values(spark, t.comma_values(F.col("a"), ("x", "y")), ["a, b,,c ", "", None, " , "]) == [
        ["a", "b", "c"], ["x", "y"], ["x", "y"], [],
    ]
    boards = ["acme-corp", "3d-node2vec", "o'neil", "ALLCAPS", "été-über"]
    assert values(spark, t.board_title(F.col("a")), boards) == [
        b.replace("-", " ").title() for b in boards
    ]


def test_window_json_and_slug(spark):
    pages = ['<script>var  _p_ = {"limit": 5,\n"query":"x"};</script>', "none", 'var _p_={"a":{"b":1},"c":2}']
    assert values(spark, t.window_json(F.col("a"), "_p_"), pages) == [
        '{"limit": 5,\n"query":"x"}', None, '{"a":{"b":1}',
    ]
    assert values(spark, t.slugify_title(F.col("a")), ["Sr. Dev / Ops!", "--", ""]) == [
        "sr-dev-ops", "job", "job",
    ]


def test_urls(spark):
    rows = [("https://a.com/b/c?x=1", "/jobs/2"), ("https://a.com/b/", "d e"), ("https://a.com", "https://z.org/q")]
    found = values(spark, absolute_url(F.col("a"), F.col("b")), rows, "a string, b string")
    assert found == [urljoin(b, h) for b, h in rows]
    roles = ["c++ & java*", "full stack~dev", "naïve"]
    found = values(spark, t.query_url("https://a.com", {"q": F.col("a"), "page": F.lit(1)}), roles)
    assert found == ["https://a.com?" + urlencode({"q": r, "page": 1}) for r in roles]


def test_age_label(spark):
    as_of = F.lit("2026-01-10T00:00:00Z").cast("timestamp")
    samples = [
        "2026-01-09T23:59:30Z", "2026-01-09T23:30:00Z", "2026-01-09T20:00:01Z", "2026-01-01T00:00:00Z",
        "2026-02-01T00:00:00Z", "soon", "", None,
    ]
    assert values(spark, t.age_label(F.col("a"), as_of), samples) == [
        "Just now", "30m ago", "3h ago", "9d ago", "Just now", "soon", "Unknown", "Unknown",
    ]


def test_embedding_text(spark):
    rows = [("T", "C", "d" * 500), (None, "C", None)]
    found = values(spark, t.embedding_text(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string")
    assert found == ["T C " + "d" * 400, " C "]
