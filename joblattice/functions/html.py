"""HTML helpers: entity decoding, tag stripping, URL joining and page selectors.

Only the rules no built-in function covers run in Python, as Arrow-batched UDFs, and
only the column they need crosses over.
"""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice.functions.text import collapse_ws, text_or_empty
from joblattice.functions.once import once_per_row


@once_per_row(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unescape(t) if t is not None and "&" in t else t)


@once_per_row(T.StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    def joined(b, h):
        if h is None:
            return None
        try:
            return urljoin(b or "", h)
        except ValueError:
            return h

    return pd.Series([joined(b, h) for b, h in zip(base, href)], dtype="object")


def strip_tags(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(c, "<[^>]+>", " "))


def clean_html_text(c: Column) -> Column:
    """Decode entities, then replace tags by a space, so that escaped tags go as well."""
    return strip_tags(unescape_html(text_or_empty(c)))


# HTML element classes that shape the tree.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HEAD_ONLY = frozenset("html head title meta link base script style noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table ul".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
}
# An end tag does not reach past an open element of a higher rank.
RANK = {"div": 2, "td": 3, "th": 3, "tr": 4, "table": 5, "body": 6, "html": 7}


class Element:
    __slots__ = ("tag", "id", "class_attr", "classes", "attrs")

    def __init__(self, tag, attrs):
        self.tag = tag
        self.attrs = dict(attrs)
        self.id = self.attrs.get("id")
        self.class_attr = self.attrs.get("class") or ""
        self.classes = self.class_attr.split()


class TreeWalker(HTMLParser):
    """Keeps the stack of open elements and reports elements and text nodes as they come."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self._pending: list[str] = []
        self._in_body = False

    def opened(self, element: Element) -> None:
        pass

    def closed(self, element: Element) -> None:
        pass

    def text_node(self, text: str) -> None:
        pass

    def walk(self, html: str):
        self.feed(html)
        self.close()
        self._flush()
        while self.stack:
            self._pop()
        return self

    def _flush(self) -> None:
        if self._pending:
            text = "".join(self._pending)
            self._pending = []
            if self.stack:
                self.text_node(text)

    def _pop(self) -> None:
        self.closed(self.stack.pop())

    def _push(self, element: Element) -> None:
        self.stack.append(element)
        self.opened(element)

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def _open_body(self, attrs=()) -> None:
        while self.stack and self.stack[-1].tag != "html":
            self._pop()
        self._push(Element("body", attrs))
        self._in_body = True

    def handle_starttag(self, tag, attrs):
        self._flush()
        if not self._in_body and (tag == "body" or tag not in HEAD_ONLY):
            self._open_body(attrs if tag == "body" else ())
        if tag == "body":
            return
        while self.stack and (
            (self.stack[-1].tag == "p" and tag in CLOSES_P)
            or tag in CLOSED_BY.get(self.stack[-1].tag, ())
        ):
            self._pop()
        element = Element(tag, attrs)
        self._push(element)
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("body", "html"):
            return
        rank = RANK.get(tag, 1)
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                self._flush()
                while len(self.stack) > depth:
                    self._pop()
                return
            if RANK.get(self.stack[depth].tag, 1) > rank:
                return

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        if not self._in_body and data.strip() and (
            not self.stack or self.stack[-1].tag in ("html", "head")
        ):
            self._open_body()
            self._push(Element("p", []))
        self._pending.append(data)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def joined(texts: list[str]) -> str:
    return " ".join(squeeze(t) for t in texts).strip()


class PageReader(TreeWalker):
    """Collects the text nodes the page adapters select on."""

    def __init__(self):
        super().__init__()
        self.first: dict[str, str] = {}
        self.body: list[str] = []
        self.content: list[str] = []
        self.job_text: list[str] = []
        self.prose: list[str] = []
        self.open_wrappers: list[tuple[Element, list[str]]] = []
        self.wrappers: list[list[str]] = []

    def opened(self, element):
        if "content-wrapper" in element.classes:
            texts: list[str] = []
            self.wrappers.append(texts)
            self.open_wrappers.append((element, texts))

    def closed(self, element):
        if self.open_wrappers and self.open_wrappers[-1][0] is element:
            self.open_wrappers.pop()

    def text_node(self, text):
        parent, above = self.stack[-1], self.stack[:-1]
        tags = {e.tag for e in above}
        keep = self.first.setdefault
        if parent.tag in ("h1", "h2", "title"):
            keep(parent.tag, text)
        if parent.tag == "h1":
            if "main" in tags:
                keep("main_h1", text)
            if "article" in tags:
                keep("article_h1", text)
        if parent.tag in ("p", "li") and ("main" in tags or "article" in tags):
            self.prose.append(text)
        for name in ("job__title", "location", "job__location"):
            if name in parent.classes:
                keep(name, text)
        for part in ("location", "remote"):
            if part in parent.class_attr:
                keep(f"any_{part}", text)
        test_id = parent.attrs.get("data-testid")
        if test_id in ("company-name", "job-location"):
            keep(test_id, text)
        if "body" in tags:
            self.body.append(text)
        if any(e.id == "content" or "job__description" in e.classes for e in above):
            self.content.append(text)
        if any(e.id == "jobDescriptionText" for e in above):
            self.job_text.append(text)
        if self.open_wrappers and parent.tag not in ("script", "style"):
            if not tags & {"script", "style"}:
                for _, texts in self.open_wrappers:
                    texts.append(text)


PAGE_FIELDS = [
    "h1", "h2", "title", "main_h1", "article_h1", "job__title", "location", "job__location",
    "any_location", "any_remote", "company-name", "job-location",
]
PAGE_TEXTS = ["body_text", "content_text", "job_text", "prose_text", "wrapper_text"]
PAGE_SCHEMA = T.StructType(
    [T.StructField(name.replace("-", "_"), T.StringType()) for name in PAGE_FIELDS]
    + [T.StructField(name, T.StringType()) for name in PAGE_TEXTS]
)


def read_page(html: str) -> tuple:
    page = PageReader().walk(html)
    firsts = [page.first.get(name) for name in PAGE_FIELDS]
    wrapped = [text for texts in page.wrappers for text in texts]
    texts = [page.body, page.content, page.job_text, page.prose, wrapped]
    return (*firsts, *[joined(t) for t in texts])


@once_per_row(PAGE_SCHEMA)
def page_fields(html: pd.Series) -> pd.DataFrame:
    """First direct text node per selector, and the joined text of the long selectors.

    A null page (one whose fields nobody needs) is not parsed and gives nulls.
    """
    nothing = (None,) * len(PAGE_SCHEMA)
    rows = [nothing if h is None else read_page(h) for h in html]
    return pd.DataFrame(rows, columns=PAGE_SCHEMA.fieldNames(), dtype="object")


class LinkReader(TreeWalker):
    """Collects board links, search results and result cards of one page."""

    def __init__(self):
        super().__init__()
        self.board: list[dict] = []
        self.results: list[dict] = []
        self.cards: list[dict] = []
        self._open: list[tuple[Element, str, dict]] = []

    def opened(self, element):
        href = element.attrs.get("href")
        if element.tag == "a":
            if href is not None and "/jobs/" in href:
                self._begin(element, "board", {"href": href, "texts": []}, self.board)
            if "result__a" in element.classes:
                self._begin(element, "result", {"href": href, "title": None}, self.results)
        for _, kind, found in self._open:
            if kind == "card" and element.tag == "a" and href is not None:
                if "h2" in self._tags_inside(found):
                    found.setdefault("href", href)
        if element.tag == "div" and "job_seen_beacon" in element.classes:
            card = {"depth": len(self.stack)}
            self._begin(element, "card", card, self.cards)

    def _begin(self, element, kind, found, target):
        target.append(found)
        self._open.append((element, kind, found))

    def _tags_inside(self, card) -> list[str]:
        return [e.tag for e in self.stack[card["depth"] : -1]]

    def closed(self, element):
        self._open = [entry for entry in self._open if entry[0] is not element]

    def text_node(self, text):
        parent = self.stack[-1]
        for element, kind, found in self._open:
            if kind == "board":
                found["texts"].append(text)
            elif kind == "result" and parent is element and found["title"] is None:
                found["title"] = text
            elif kind == "card":
                inside = self._tags_inside(found)
                if parent.tag == "span":
                    if "h2" in inside and "a" in inside[inside.index("h2") :]:
                        found.setdefault("title", text)
                    if "companyName" in parent.classes:
                        found.setdefault("company", text)
                    if "date" in parent.classes:
                        found.setdefault("posted_at", text)
                elif parent.tag == "div" and "companyLocation" in parent.classes:
                    found.setdefault("location", text)


LINK_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField(name, T.StringType())
            for name in ("href", "title", "company", "location", "posted_at")
        ]
    )
)


def _board_links(html: str) -> list[dict]:
    if "/jobs/" not in html:
        return []
    links = LinkReader().walk(html).board
    return [{"href": link["href"], "title": " ".join(link["texts"]).strip()} for link in links]


def _result_links(html: str) -> list[dict]:
    if "result__a" not in html:
        return []
    links = LinkReader().walk(html).results
    return [{"href": link["href"], "title": (link["title"] or "").strip()} for link in links]


def _card_links(html: str) -> list[dict]:
    if "job_seen_beacon" not in html:
        return []

    def text(card, name):
        return card.get(name, "").strip()

    return [
        {
            "href": card.get("href"),
            "title": text(card, "title"),
            "company": text(card, "company"),
            "location": text(card, "location"),
            "posted_at": text(card, "posted_at") or None,
        }
        for card in LinkReader().walk(html).cards
    ]


def _link_udf(links_of, absolute: bool):
    names = LINK_SCHEMA.elementType.fieldNames()

    def resolve(base: str, link: dict) -> dict:
        href = link.get("href")
        if absolute and href:
            link = {**link, "href": urljoin(base or "", href)}
        return {name: link.get(name) for name in names}

    @once_per_row(LINK_SCHEMA)
    def links(base: pd.Series, html: pd.Series) -> pd.Series:
        found = [
            None if page is None else [resolve(url, link) for link in links_of(page)]
            for url, page in zip(base, html)
        ]
        return pd.Series(found, dtype="object")

    return links


board_links = _link_udf(_board_links, absolute=True)
result_links = _link_udf(_result_links, absolute=False)
card_links = _link_udf(_card_links, absolute=True)
