"""Text functions as Column expressions."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(c: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Stripped; blank is NULL."""
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def section(c: Column) -> Column:
    return F.substring(F.nullif(collapse(c), F.lit("")), 1, 50)


def code2(c: Column) -> Column:
    """Country or language: the first two letters, lower case; blank stays blank."""
    return F.substring(F.lower(strip(c)), 1, 2)


def host(c: Column) -> Column:
    """Host name of a URL or of host[:port][/path], lower case; blank or unreadable is NULL."""
    s = clean(c)
    absolute = F.when(F.contains(s, F.lit("//")), s).otherwise(F.concat(F.lit("//"), s))
    return F.nullif(F.lower(F.try_parse_url(absolute, F.lit("HOST"))), F.lit(""))


def company_name(file_name: Column) -> Column:
    """From a catalog file's name: the stem, with spaces for underscores; NULL if nothing is left."""
    return F.nullif(collapse(F.replace(F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))), F.lit(""))


def distinct_texts(c: Column) -> Column:
    """Stripped texts without blanks; the first of equals stays, in order."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda x: x != ""))


def tag_slugs(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.regexp_replace(F.lower(strip(x)), r"(?U)\s+", "-")), lambda x: x != ""))


def protection_or(c: Column, default: Column) -> Column:
    """In range 0 to 2, else the default put into that range."""
    return F.when(c.between(0, 2), c).otherwise(clamp(default))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(2), c))


def effective_protection(feed: Column, company: Column) -> Column:
    """The feed's own level if in range, else the company's, else 1."""
    return F.coalesce(F.when(feed.between(0, 2), feed), F.when(company.between(0, 2), company), F.lit(1))


def company_key(company_id: Column, feed_id: Column) -> Column:
    return F.when(company_id > 0, F.concat(F.lit("company:"), company_id.cast("string"))).otherwise(F.concat(F.lit("feed:"), feed_id.cast("string")))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(amp;?|[A-Za-z][A-Za-z0-9]*;|#[0-9]+;|#[xX][0-9a-fA-F]+;)")


@F.pandas_udf(T.StringType())
def _unescape_closed(s: pd.Series) -> pd.Series:
    one = lambda m: html.unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0])
    return s.map(lambda x: _CLOSED.sub(one, x), na_action="ignore")


def unescape(c: Column, closed: bool = False) -> Column:
    """HTML character references as characters. Only texts with & go through Python. closed: those without a semicolon, as at the end of
    a cut text, stay as they are, but for &amp."""
    some = F.when(F.contains(c, F.lit("&")), c)
    return F.when(some.isNotNull(), _unescape_closed(some) if closed else _unescape(some)).otherwise(c)


def drop_markup(c: Column) -> Column:
    """Tags as spaces, white space collapsed, no space before punctuation; blank is NULL."""
    return F.nullif(F.regexp_replace(collapse(F.regexp_replace(c, r"<[^>]+>", " ")), r"(?U)\s+([,.;:!?])", "$1"), F.lit(""))


def strip_html(c: Column, closed: bool = False) -> Column:
    return drop_markup(unescape(c, closed))


def plain_references(c: Column) -> Column:
    """The common character references in attribute values, JVM-side (usable in lambdas)."""
    for reference, text in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(reference), F.lit(text))
    return c


def html_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag's text (double, single or no quotes); blank is NULL."""
    found = F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.nullif(strip(plain_references(F.regexp_replace(found, r"^([\"'])(.*)\1$", "$2"))), F.lit(""))


def image_tags(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))


def dimension(c: Column) -> Column:
    """The first run of digits, if over 0."""
    return F.nullif(F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit("")).try_cast("bigint"), F.lit(0))


def query_dimension(url: Column, names: list[str]) -> Column:
    """The largest dimension among a URL's query parameters of these names (any case)."""
    pairs = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    named = F.filter(pairs, lambda p: F.lower(F.substring_index(p, "=", 1)).isin(names))
    return F.array_max(F.transform(named, lambda p: dimension(F.regexp_extract(p, "=(.*)$", 1))))


def srcset(c: Column) -> Column:
    """Candidates of a srcset: array of (url, width); only descriptors in w give a width."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda p: p != "")

    def one(p: Column) -> Column:
        words = F.split(p, r"\s+")
        width = F.when(F.lower(F.element_at(words, -1)).endswith("w"), dimension(F.regexp_extract(p, r"\s(.*)$", 1)))
        return F.struct(F.get(words, F.lit(0)).alias("url"), F.when(F.size(words) > 1, width).alias("width"))

    return F.transform(parts, one)


def feed_label(feed_id: Column, company: Column, feed_section: Column) -> Column:
    """#id - company / section, with what is missing left out."""
    head = F.concat(F.lit("#"), feed_id.cast("string"))
    rest = F.concat_ws(" / ", company, feed_section)
    return F.when(rest == "", head).otherwise(F.concat(head, F.lit(" - "), rest))


def company_names(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("Unknown company"))


def trust_percent(score: Column) -> Column:
    return F.round(F.least(F.greatest(score * 100, F.lit(0.0)), F.lit(100.0))).cast("int")


def file_extension(c: Column) -> Column:
    """Lower case with one leading dot; blank is .json."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^\.+", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(".json")).otherwise(F.concat(F.lit("."), bare))
