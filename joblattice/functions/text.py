"""Text rules as Column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four C0 separators, which Python also treats as white space.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
NOT_WHITESPACE = r"(?U)[^\s\x1c-\x1f]"
# The places where Python's splitlines() breaks.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def non_empty(*candidates: Column) -> Column:
    """First candidate that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITESPACE, " "))


def strip_ws(c: Column) -> Column:
    """Remove white space at both ends and keep it inside."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def truthy(c: Column) -> Column:
    """A JSON scalar, read as text, that is neither null, empty, false nor zero."""
    return F.coalesce(~F.lower(c).isin("", "false", "0"), F.lit(False))


def is_blank(c: Column) -> Column:
    """Null or without a single visible character; stops at the first one."""
    return ~F.coalesce(c.rlike(NOT_WHITESPACE), F.lit(False))


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def matches_role(c: Column, role: str) -> Column:
    """True if every role word of two or more letters occurs in the text.

    A text holding the whole role phrase holds each of its words, so the phrase only
    has to be looked for when the role has no such word.
    """
    phrase = re.sub("[^a-z0-9]+", " ", role.lower()).strip()
    words = [word for word in phrase.split() if len(word) >= 2]
    needles = words or ([phrase] if phrase else [])
    if not needles:
        return F.lit(False)
    haystack = normalize_text(text_or_empty(c))
    found = haystack.contains(needles[0])
    for needle in needles[1:]:
        found = found & haystack.contains(needle)
    return found


def listing_id(source: Column, url: Column) -> Column:
    return F.sha2(F.concat(text_or_empty(source), F.lit(":"), text_or_empty(url)), 256)


def epoch_to_iso(c: Column) -> Column:
    """Epoch seconds or milliseconds, given as text, to ISO-8601 UTC text.

    Null and empty give null; text that is no number, or no date before the year
    10000, comes back as it is.
    """
    text = c.cast("string")
    parsed = F.trim(text).try_cast("double")
    is_date = F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & parsed.between(
        -62135596800.0, 253402300799999.0
    )
    number = F.when(is_date, parsed)
    seconds = number / F.when(number > 10_000_000_000, 1000.0).otherwise(1.0)
    whole = seconds.cast("long")
    micros = whole * 1_000_000 + F.rint((seconds - whole) * 1e6).cast("long")
    iso = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    iso = F.concat(F.regexp_replace(iso, r"\.000000$", ""), F.lit("+00:00"))
    return F.coalesce(iso, F.nullif(text, F.lit("")))


def comma_values(c: Column, defaults: Sequence[str]) -> Column:
    """Comma list to array; an unset list gives the defaults."""
    parts = F.filter(
        F.transform(F.split(c, ","), lambda part: collapse_ws(part)), lambda part: part != ""
    )
    fallback = F.array(*[F.lit(value) for value in defaults])
    return F.when(F.nullif(c, F.lit("")).isNull(), fallback).otherwise(parts)


def title_case(c: Column) -> Column:
    """Upper-case each letter that does not follow a letter, lower-case the others."""
    letters = F.split(c, "")

    def cased(letter: Column, i: Column) -> Column:
        previous = F.get(letters, i - 1)
        after_letter = (i > 0) & previous.rlike(r"^[\p{Lu}\p{Ll}\p{Lt}]$")
        return F.when(after_letter, F.lower(letter)).otherwise(F.upper(letter))

    return F.array_join(F.transform(letters, cased), "")


def board_title(board: Column) -> Column:
    return title_case(F.replace(board, F.lit("-"), F.lit(" ")))


def window_json(html: Column, variable: str) -> Column:
    """Text of ``var NAME = {...}`` up to the first closing brace; null if absent."""
    pattern = rf"(?s)var\s+{re.escape(variable)}\s*=\s*(\{{.*?\}})"
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def slugify_title(c: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(non_empty(slug), F.lit("job"))


def plus_encode(c: Column) -> Column:
    """Form encoding: letters, digits and ``-._~`` stay, a space becomes ``+``."""
    encoded = F.url_encode(c.cast("string"))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_url(base: str, params: dict[str, Column]) -> Column:
    pairs = [F.concat(F.lit(f"{name}="), plus_encode(value)) for name, value in params.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *pairs))


# Fixed value: how much of a description is embedded.
EMBEDDED_CHARS = 400


def embedding_text(
    title: Column, company: Column, description: Column, max_chars: int | None = EMBEDDED_CHARS
) -> Column:
    """What gets embedded: title, company and the first ``max_chars`` characters of the description (all if None)."""
    text = text_or_empty(description)
    return F.concat_ws(
        " ",
        text_or_empty(title),
        text_or_empty(company),
        text if max_chars is None else F.substring(text, 1, max_chars),
    )


def age_label(value: Column, as_of: Column) -> Column:
    """Age of a moment relative to ``as_of``: Just now, 5m ago, 3h ago, 2d ago."""
    moment = value.try_cast("timestamp")
    age = F.greatest(
        F.lit(0), F.floor((F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(moment)) / 1000)
    )

    def ago(unit_seconds: int, suffix: str) -> Column:
        return F.concat(F.floor(age / unit_seconds).cast("string"), F.lit(f"{suffix} ago"))

    return (
        F.when(F.nullif(value.cast("string"), F.lit("")).isNull(), F.lit("Unknown"))
        .when(moment.isNull(), value.cast("string"))
        .when(age < 60, F.lit("Just now"))
        .when(age < 3600, ago(60, "m"))
        .when(age < 86400, ago(3600, "h"))
        .otherwise(ago(86400, "d"))
    )
