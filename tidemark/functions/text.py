"""News text helpers on JVM string functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tracking parameters dropped from links, date formats tried in order, entities decoded
TRACKING = r"[?&](utm_[^&]+|ref=[^&]+|source=[^&]+)"
DATE_FORMATS = ("dd MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd'T'HHmmss", "yyyyMMdd")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def link_key(url) -> Column:
    """Link without tracking parameters and without a dangling separator."""
    return F.regexp_replace(F.regexp_replace(_c(url), TRACKING, ""), r"[?&]$", "")


def publisher_of(title) -> Column:
    """What follows the last " - " of a title, empty if there is none."""
    return F.trim(F.regexp_extract(_c(title), r"(?s)^.* - (.*?)$", 1))


def headline_of(title) -> Column:
    t = _c(title)
    return F.when(F.instr(t, " - ") > 0, F.regexp_extract(t, r"(?s)^(.*) - .*?$", 1)).otherwise(t)


def any_date(s, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses (a leading weekday name is ignored), else the leading ISO date."""
    s = F.regexp_replace(_c(s), r"^[A-Za-z]{3}, ", "")
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in formats]
    return F.to_date(F.coalesce(*tries, F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd"))))


def stable_id(*parts, length: int = 12) -> Column:
    return F.substring(F.md5(F.concat_ws("", *[_c(p).cast("string") for p in parts]).cast("binary")), 1, length)


def with_link(url, base: str, *parts) -> Column:
    """The link, or a deterministic one from a hash of the parts."""
    u = F.trim(_c(url))
    return F.when(F.length(u) > 0, u).otherwise(F.concat(F.lit(base), stable_id(*parts)))


def filing_title(category, description, fallback) -> Column:
    d = F.trim(F.coalesce(_c(description), F.lit("")))
    return F.concat(F.lit("["), F.trim(_c(category)), F.lit("] "), F.when(F.length(d) > 0, d).otherwise(F.trim(_c(fallback))))


def body_of(html, least: int = 60) -> Column:
    """Visible lines of an HTML fragment; null unless longer than ``least`` characters."""
    h = F.regexp_replace(_c(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    h = F.regexp_replace(F.regexp_replace(h, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)[^>]*>", "\n"), r"(?s)<[^>]+>", "")
    for a, b in ENTITIES:
        h = F.replace(h, F.lit(a), F.lit(b))
    lines = F.filter(F.transform(F.split(h, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 0)
    body = F.array_join(lines, "\n")
    return F.when(F.length(body) > least, body)
