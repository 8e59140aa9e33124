"""Which page comes next: sitemaps, result pages, boards and links, as row-wise jobs.

Every rule works on the one captured response that holds the candidates, so caps,
reversal and duplicate removal are array operations on that row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.html import board_links, card_links, result_links
from joblattice.functions.once import computed_once
from joblattice.functions.text import (
    comma_values, matches_role, non_empty, query_url, text_or_empty, window_json,
)
from joblattice.schema import MAX_PAGES
from joblattice.sources.feeds import captured

# Endpoints, default boards and page sizes of the sources.
FEED_ENDPOINTS = {
    "arbeitnow": "https://www.arbeitnow.com/api/job-board-api",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{board}?includeCompensation=true",
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{board}/jobs?content=true",
    "himalayas": "https://himalayas.app/jobs/api",
    "lever": "https://api.lever.co/v0/postings/{board}?mode=json",
}
DEFAULT_BOARDS = {
    "greenhouse": ("airbnb", "stripe"),
    "lever": ("palantir",),
    "ashby": ("ashby",),
}
SITEMAPS = {
    "cutshort": "https://cutshort.io/sitemap_jobs.xml",
    "foundit": "https://www.foundit.in/xmlsitemap/todays-jobs-sitemap.xml",
    "forage_ai": "https://forage.ai/job-opportunities-sitemap.xml",
}
INDEED_SEARCH = "https://in.indeed.com/jobs"
INDEED_PAGE_SIZE = 10
INDEED_SECURITY_TEXT = "Security Check - Indeed.com"
FOUNDIT_SEARCH = "https://www.foundit.in/srp/results"
FOUNDIT_RESULTS = "https://www.foundit.in/middleware/jobsearch"
FOUNDIT_STATE = "_seoHtmlProps_"
FOUNDIT_LIMIT = 25
HIMALAYAS_PAGE_SIZE = 20
DDG_SEARCH = "https://duckduckgo.com/html/"
DDG_SITES = "site:linkedin.com/jobs OR site:cutshort.io"

_COMMENT = r"(?s)<!--.*?-->"
_LOC = r"(?s)<(?:[\w.\-]+:)?loc(?:\s[^>]*)?>(.*?)</(?:[\w.\-]+:)?loc\s*>"
_CDATA = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
# The named entities of XML.
_XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]


def _code_point(digits: Column, base: int) -> Column:
    """The character of a code point; null where there is none (too large, or half a pair)."""
    code = F.conv(digits, base, 10).cast("long")
    is_one = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(is_one, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _xml_text(body: Column) -> Column:
    """Text of an XML element: CDATA as it is, else with entities decoded once."""
    number = r"^&#([xX][0-9A-Fa-f]{1,12}|[0-9]{1,12});"

    def with_number(piece: Column) -> Column:
        character = F.when(piece.rlike("^&#[xX]"), _code_point(F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]+);", 1), 16)).otherwise(
            _code_point(F.regexp_extract(piece, r"^&#([0-9]+);", 1), 10))
        rest = F.regexp_replace(piece, number, "")
        return F.when(piece.rlike(number) & character.isNotNull(), F.concat(character, rest)).otherwise(piece)

    def with_numbers(text: Column) -> Column:
        # pieces between the references, each with the reference in front of it
        return F.array_join(F.transform(F.split(text, "(?=&#)"), with_number), "")

    decoded = F.when(body.contains("&#"), with_numbers(body)).otherwise(body)
    for entity, character in _XML_ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(character))
    decoded = F.replace(decoded, F.lit("&amp;"), F.lit("&"))
    cdata = F.regexp_extract(body, _CDATA, 1)
    return F.btrim(F.when(body.rlike(_CDATA), cdata).otherwise(decoded), F.lit(" \t\r\n"))


def sitemap_locs(body: Column) -> Column:
    """All loc texts of a sitemap in document order; broken XML still gives what it holds."""
    found = F.regexp_extract_all(F.regexp_replace(body, _COMMENT, ""), F.lit(_LOC), F.lit(1))
    return F.filter(F.transform(found, _xml_text), lambda url: url != "")


def sitemap_urls(captures: DataFrame) -> DataFrame:
    maps = computed_once(captures.filter("kind = 'sitemap'"), urls=sitemap_locs(F.col("body")))
    return maps.select("source", "seq", F.posexplode("urls").alias("pos", "url"))


def sitemap_cap(max_pages: int = MAX_PAGES) -> int:
    return max(max_pages * 10, 10)


def sitemap_frontier(
    captures: DataFrame,
    role: str | None = None,
    cap: int | None = None,
    distinct: bool = False,
    reverse: bool = False,
    path_contains: str | None = None,
) -> DataFrame:
    """The first ``cap`` wanted urls of each sitemap, in order (from the end if reversed)."""
    urls = sitemap_locs(F.col("body"))
    if reverse:
        urls = F.reverse(urls)
    if path_contains is not None:
        urls = F.filter(urls, lambda url: url.contains(path_contains))
    if role is not None:
        urls = F.filter(urls, lambda url: matches_role(url, role))
    if distinct:
        urls = F.array_distinct(urls)
    urls = F.slice(urls, 1, sitemap_cap() if cap is None else cap)
    maps = computed_once(captures.filter("kind = 'sitemap'"), urls=urls)
    return maps.select("source", "seq", F.posexplode("urls").alias("pos", "url"))


def cutshort_frontier(captures: DataFrame, role: str, max_pages: int = MAX_PAGES) -> DataFrame:
    maps = captured(captures, "cutshort", "sitemap")
    return sitemap_frontier(maps, role, sitemap_cap(max_pages), distinct=True)


def foundit_frontier(captures: DataFrame, role: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """Repeated urls count towards the cap."""
    return sitemap_frontier(captured(captures, "foundit", "sitemap"), role, sitemap_cap(max_pages))


def forage_frontier(captures: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    return sitemap_frontier(
        captured(captures, "forage_ai", "sitemap"),
        cap=sitemap_cap(max_pages),
        reverse=True,
        path_contains="/job-opportunities/",
    )


def page_frontier(
    searches: DataFrame, max_pages: int = MAX_PAGES, page_size: Column | int = INDEED_PAGE_SIZE
) -> DataFrame:
    """Every search row once per result page, with ``page`` and ``start`` = page * size."""
    size = F.lit(page_size) if isinstance(page_size, int) else page_size
    pages = F.sequence(F.lit(0), F.lit(max_pages - 1)) if max_pages > 0 else F.array().cast("array<int>")
    return searches.withColumn("page", F.explode(pages)).withColumn("start", F.col("page") * size)


def indeed_pages(roles: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Result page urls for rows with a ``role``."""
    pages = page_frontier(roles, max_pages)
    params = {
        "q": F.col("role"), "l": F.lit("India"), "fromage": F.lit("7"), "start": F.col("start"),
    }
    return pages.withColumn("url", query_url(INDEED_SEARCH, params))


def ddg_search(roles: DataFrame) -> DataFrame:
    query = F.concat(F.lit(f"{DDG_SITES} "), F.col("role"))
    return roles.withColumn("url", query_url(DDG_SEARCH, {"q": query}))


def foundit_search(roles: DataFrame) -> DataFrame:
    params = {"query": F.col("role"), "locations": F.lit("India")}
    return roles.withColumn("url", query_url(FOUNDIT_SEARCH, params))


def foundit_pages(captures: DataFrame, role: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """Result requests planned from the state embedded in a search page.

    What the state leaves out has a default; a page without a state, or with an empty one,
    gives no request.
    """
    text = window_json(F.col("body"), FOUNDIT_STATE)
    state = F.from_json(text, "query string, locations string, limit string")
    searches = computed_once(
        captured(captures, "foundit_demo", "search"), state=state, keys=F.size(F.json_object_keys(text)))
    has_state = F.coalesce(F.col("keys"), F.lit(0)) > 0
    limit = F.coalesce(F.col("state.limit").try_cast("int"), F.lit(FOUNDIT_LIMIT))
    known = searches.filter(has_state).select("source", "seq", "state", limit.alias("limit"))
    pages = page_frontier(known, max_pages, F.col("limit"))
    params = {
        "query": F.coalesce("state.query", F.lit(role)),
        "locations": F.coalesce("state.locations", F.lit("India")),
        "start": F.col("start"),
        "limit": F.col("limit"),
    }
    return pages.select("source", "seq", "page", "start", query_url(FOUNDIT_RESULTS, params).alias("url"))


def himalayas_next(captures: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """The request after each captured page, while pages and the total count last."""
    total = F.coalesce(
        F.from_json("body", "totalCount string")["totalCount"].try_cast("long"), F.lit(0)
    )
    counted = computed_once(captured(captures, "himalayas", "feed"), total=total)
    following = counted.select(
        "source", "seq", (F.col("page") + 1).alias("page"), "total"
    ).withColumn("start", F.col("page") * HIMALAYAS_PAGE_SIZE)
    params = {"limit": F.lit(HIMALAYAS_PAGE_SIZE), "offset": F.col("start")}
    return following.filter((F.col("page") < max_pages) & (F.col("start") < F.col("total"))).select(
        "source", "seq", "page", query_url(FEED_ENDPOINTS["himalayas"], params).alias("url")
    )


def arbeitnow_next(captures: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """The next link of each captured page below the page limit; pages count from one."""
    link = F.from_json("body", "links struct<next: string>")["links"]["next"]
    early = captured(captures, "arbeitnow", "feed").filter(F.col("page") < max_pages)
    linked = computed_once(early, next=non_empty(link)).filter("next is not null")
    return linked.select(
        "source", "seq", (F.col("page") + 1).alias("page"), F.col("next").alias("url")
    )


def board_frontier(requests: DataFrame, source: str) -> DataFrame:
    """One feed url per board of a comma list ``boards``; an unset list gives the defaults."""
    before, after = FEED_ENDPOINTS[source].split("{board}")
    boards = comma_values(F.col("boards"), DEFAULT_BOARDS[source])
    return requests.withColumn("board", F.explode(boards)).withColumn(
        "url", F.concat(F.lit(before), F.col("board"), F.lit(after))
    )


_RECORD = ["title", "company", "location", "posted_at"]


def _records(pages: DataFrame, links: Column) -> DataFrame:
    exploded = pages.withColumn("links", links).select(
        "source", "seq", F.posexplode("links").alias("pos", "link")
    )
    return exploded.select(
        "source",
        "seq",
        "pos",
        non_empty(F.col("link.href")).alias("url"),
        *[F.col(f"link.{name}").alias(name) for name in _RECORD],
        F.lit("").alias("description"),
        F.lit(1).alias("fetched"),
    )


def board_link_frontier(captures: DataFrame, role: str) -> DataFrame:
    """Distinct job links of each rendered board whose text matches the role."""
    pages = captured(captures, "greenhouse_playwright", "board")
    linked = pages.withColumn("links", board_links(F.col("url"), F.col("body")))
    wanted = F.filter(
        "links", lambda link: (text_or_empty(link["href"]) != "") & matches_role(link["title"], role)
    )
    urls = F.array_distinct(F.transform(wanted, lambda link: link["href"]))
    return linked.select("source", "seq", F.posexplode(urls).alias("pos", "url"))


def result_link_frontier(captures: DataFrame) -> DataFrame:
    """Search results as records; a result without a link only counts as fetched."""
    pages = captured(captures, "ddg", "search")
    return _records(pages, result_links(F.col("url"), F.col("body")))


def card_frontier(captures: DataFrame) -> DataFrame:
    """Result cards as records; a page with the security check is left out whole."""
    pages = captured(captures, "indeed", "search").filter(~F.col("body").contains(INDEED_SECURITY_TEXT))
    return _records(pages, card_links(F.col("url"), F.col("body")))


def search_records(frontier: DataFrame) -> DataFrame:
    return frontier.filter(F.col("url").isNotNull())


def fetched_counts(*frontiers: DataFrame) -> DataFrame:
    """Rows counted as fetched per source."""
    counts = [
        f.groupBy("source").agg(F.sum("fetched").cast("long").alias("fetched")) for f in frontiers
    ]
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    return total
