"""JSON-LD blocks as Variant columns; one row per page throughout, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblattice.functions.text import non_empty

# The script type, and where JSON allows white space.
LD_TYPE = "application/ld+json"
JSON_SPACE = " \t\r\n"
# A comment or a whole script element, whichever starts first, so that neither a
# commented-out script nor markup quoted inside another script is taken for a block.
_ELEMENT = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script"
_LD_ELEMENT = r"""(?i)^<script[^>]*?\stype\s*=\s*(?-i:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?:\s|/?>))"""
_CONTENT = r"(?s)^[^>]*>(.*).{8}$"


def json_ld_scripts(html: Column) -> Column:
    """Raw text of every ``application/ld+json`` script, in document order.

    Pages without the type are not searched.
    """
    candidate = F.when(html.contains(LD_TYPE), html)
    elements = F.filter(
        F.regexp_extract_all(candidate, F.lit(_ELEMENT), F.lit(0)), lambda e: e.rlike(_LD_ELEMENT)
    )
    texts = F.transform(elements, lambda e: F.regexp_extract(e, _CONTENT, 1))
    return F.coalesce(texts, F.array().cast("array<string>"))


def as_list(v: Column) -> Column:
    """Array of the variant's elements; null if it is no JSON array."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def json_ld_blocks(scripts: Column) -> Column:
    """Every JSON object in the scripts; lists are flattened, bad JSON is skipped."""

    def parsed(raw: Column) -> Column:
        text = F.btrim(raw, F.lit(JSON_SPACE))
        braced = text.startswith("{") & text.endswith("}")
        listed = text.startswith("[") & text.endswith("]")
        return F.try_parse_json(F.when(braced | listed, text))

    documents = F.transform(scripts, parsed)
    items = F.transform(documents, lambda doc: F.coalesce(as_list(doc), F.array(doc)))
    return F.filter(F.flatten(items), is_object)


def job_posting(blocks: Column) -> Column:
    """First block typed exactly JobPosting; null if there is none."""
    return F.get(F.filter(blocks, lambda b: field(b, '$["@type"]') == "JobPosting"), F.lit(0))


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda part: part != ""), ", ")


def _address_text(address: Column) -> Column:
    return F.coalesce(
        non_empty(
            field(address, "$.addressLocality"),
            field(address, "$.streetAddress"),
            field(address, "$.addressRegion"),
        ),
        F.lit(""),
    )


def _leaves(value: Column, inner: Callable[[Column], Column]) -> Column:
    """The value as a list without lists: a list gives way to its elements, level by level.

    ``inner`` is the list an element stands for, null if it is none. The work list is opened until
    no list is left; a level takes a bracket of the text at least, so their number is a bound.
    """
    text = F.to_json(value)
    levels = F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))

    def opened(state: Column, _: Column) -> Column:
        items = F.flatten(F.transform(state["items"], lambda v: F.coalesce(inner(v), F.array(v))))
        more = F.exists(state["items"], lambda v: inner(v).isNotNull())
        return F.when(state["more"], F.struct(items.alias("items"), more.alias("more"))).otherwise(state)

    start = F.struct(F.array(value).alias("items"), F.lit(True).alias("more"))
    return F.aggregate(steps, start, opened)["items"]


def _address(place: Column) -> Column:
    return F.try_variant_get(place, "$.address", "variant")


def extract_location(location: Column) -> Column:
    """The places' addresses as text; an address that is a list holds places again."""
    listed = _leaves(location, lambda place: F.coalesce(as_list(place), as_list(_address(place))))
    many = as_list(location).isNotNull() | as_list(_address(location)).isNotNull()
    texts = F.transform(listed, lambda place: _address_text(_address(place)))
    return F.when(many, _joined(texts)).otherwise(_address_text(_address(location)))


def _organization_text(v: Column) -> Column:
    return F.coalesce(
        F.when(is_object(v), field(v, "$.name")).otherwise(field(v, "$")), F.lit("")
    )


def extract_company(organization: Column) -> Column:
    """The first name in a list of organizations, or in lists within it."""
    names = F.filter(F.transform(_leaves(organization, as_list), _organization_text), lambda name: name != "")
    return F.when(as_list(organization).isNotNull(), F.coalesce(F.get(names, F.lit(0)), F.lit(""))).otherwise(
        _organization_text(organization))


def webpage_date(blocks: Column) -> Column:
    """``datePublished`` of the first WebPage in a block's ``@graph``; first non-empty wins."""

    def date_of(block: Column) -> Column:
        graph = F.try_variant_get(block, '$["@graph"]', "array<variant>")
        pages = F.filter(graph, lambda e: field(e, '$["@type"]') == "WebPage")
        return field(F.get(pages, F.lit(0)), "$.datePublished")

    return F.get(F.filter(F.transform(blocks, date_of), lambda d: d != ""), F.lit(0))
