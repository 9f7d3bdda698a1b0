"""Payloads as variants: the rules of requests and results down to their feeds and entries, and their typed values.

A payload is parsed once and opened into the kinds and texts of its fields, on which rules and values are expressions. A rule sees the kind that a value has in the JSON: a number is no text, text that holds a whole
number is a number, a missing field takes its default and an explicit null does not. Times may be ISO 8601 (without a zone: UTC), a date,
or seconds since 1970. A request or a result that breaks one rule anywhere is refused as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.dates import in_utc
from tidemill.schemas import PROTECTION_DEFAULT, PROTECTION_MAX, STATUSES

_TRUE, _FALSE = ["true", "t", "yes", "y", "on", "1"], ["false", "f", "no", "n", "off", "0"]


def parse(payload: Column) -> Column:
    """The payload as a variant, NULL unless it is a JSON object."""
    v = F.try_parse_json(payload)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def field(v: Column, name: str) -> Column:
    """kind and text of a field, looked up once: NULL if it is missing, kind VOID if it is null."""
    return _scalar(F.try_variant_get(v, f"$.{name}", "variant"))


def _scalar(x: Column) -> Column:
    return _let(x, lambda y: F.when(y.isNotNull(), F.struct(F.schema_of_variant(y).alias("kind"), F.try_variant_get(y, "$", "string").alias("text"))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(x: Column) -> Column:
    return F.coalesce(x["kind"], F.lit(""))


def _text(x: Column) -> Column:
    return x["text"]


def _nothing(x: Column) -> Column:
    """Missing or null."""
    return x.isNull() | (x["kind"] == "VOID")


def is_text(x: Column, least: int = 0, most: int = 1 << 30) -> Column:
    return F.coalesce((_kind(x) == "STRING") & F.length(_text(x)).between(least, most), F.lit(False))


def whole_number(x: Column) -> Column:
    """The value of a whole number, or of text that holds one; NULL for all else."""
    exact = _text(x).try_cast("decimal(38,9)")
    numeric = (_kind(x) == "BIGINT") | _kind(x).startswith("DECIMAL") | _kind(x).isin("DOUBLE", "FLOAT") | ((_kind(x) == "STRING") & _text(x).rlike(r"^\s*[+-]?\d+(?:\.0+)?\s*$"))
    return F.when(_kind(x) == "BOOLEAN", (_text(x) == "true").cast("long")).when(numeric & (exact == F.floor(exact)), exact.try_cast("long"))


def is_number(x: Column, least: int, most: int = (1 << 63) - 1) -> Column:
    return F.coalesce(whole_number(x).between(least, most), F.lit(False))


def flag(x: Column) -> Column:
    """The value of a truth value or of what is read as one; NULL for all else."""
    # 1.0 is written as 1
    text = F.regexp_replace(F.lower(_text(x)), r"\.0+$", "")
    plain = ~_kind(x).startswith("OBJECT") & ~_kind(x).startswith("ARRAY")
    return F.when(plain & text.isin(_TRUE), True).when(plain & text.isin(_FALSE), False)


def moment(x: Column) -> Column:
    """The time of a value in UTC; NULL for what is no time."""
    text, kind = F.trim(_text(x)), _kind(x)
    day = text.rlike(r"^\d{4}-\d\d-\d\d$")
    full = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?(?:[Zz]|[+-]\d\d:?\d\d)?$")
    iso = F.replace(F.upper(text), F.lit(" "), F.lit("T"))
    zoned = F.when(iso.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), in_utc(F.try_to_timestamp(F.regexp_replace(iso, r"([+-]\d\d):?(\d\d)$", "$1:$2")))).otherwise(F.regexp_replace(iso, "Z$", "").try_cast("timestamp_ntz"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    # beyond some 600 years the number counts milliseconds
    seconds = text.try_cast("double")
    seconds = F.when(F.abs(seconds) > 2e10, seconds / 1000).otherwise(seconds)
    return F.when((kind == "STRING") & (day | full), zoned).when(number & (F.abs(seconds) < 2e11), in_utc(F.timestamp_micros((seconds * 1e6).cast("long"))))


def _optional(x: Column, rule: Column) -> Column:
    return _nothing(x) | rule


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))


def _opened(v: Column, names: list[str], items: str, item_names: list[str]) -> Column:
    """A payload's fields, and of its list `items` the kind and each item: whether it is an object, and its fields."""
    x = F.try_variant_get(v, f"$.{items}", "variant")
    each = F.transform(F.try_variant_get(v, f"$.{items}", "array<variant>"), lambda i: F.struct(F.schema_of_variant(i).startswith("OBJECT").alias("_object"), *(field(i, n).alias(n) for n in item_names)))
    return F.when(v.isNotNull(), F.struct(*(field(v, n).alias(n) for n in names), F.when(x.isNotNull(), F.coalesce(F.schema_of_variant(x), F.lit(""))).alias("_kind"), F.coalesce(each, F.array()).alias("_items")))


def opened_request(v: Column) -> Column:
    return _opened(v, ["job_id", "requested_at", "ingest", "requested_by"], "feeds", ["feed_id", "feed_url", "company_id", "host_header", "fetchprotection", "etag", "last_update", "last_db_article_published_at"])


def opened_result(v: Column) -> Column:
    names = ["job_id", "ingest", "feed_id", "feed_url", "status", "error_message", "new_etag", "new_last_update", "fetchprotection"]
    return _opened(v, names, "sources", ["title", "url", "summary", "author", "published_at", "image_url"])


def _of_list(o: Column, name: str, rules: Callable[[Column], dict[str, Column]]) -> Column:
    """Names of rules that an item of a list breaks (behind the list's name), or the list's name if it is none; a missing one is
    empty."""
    inner = F.flatten(F.transform(o["_items"], lambda i: F.when(i["_object"], _broken(rules(i))).otherwise(F.array(F.lit("item")))))
    return F.when(~o["_kind"].startswith("ARRAY"), F.array(F.lit(name))).otherwise(F.transform(inner, lambda r: F.concat(F.lit(f"{name}."), r)))


def _feed_rules(f: Column) -> dict[str, Column]:
    level = f["fetchprotection"]
    return {
        "feed_id": is_number(f["feed_id"], 1),
        "feed_url": is_text(f["feed_url"], 1, 500),
        "company_id": _optional(f["company_id"], is_number(f["company_id"], 1)),
        "host_header": _optional(f["host_header"], is_text(f["host_header"], 1, 255)),
        "fetchprotection": level.isNull() | is_number(level, 0, PROTECTION_MAX),
        "etag": _optional(f["etag"], is_text(f["etag"], 0, 255)),
        **{name: _optional(f[name], moment(f[name]).isNotNull()) for name in ("last_update", "last_db_article_published_at")},
    }


def _entry_rules(s: Column) -> dict[str, Column]:
    return {
        "title": is_text(s["title"], 1),
        "url": is_text(s["url"], 1, 1000),
        **{name: _optional(s[name], is_text(s[name])) for name in ("summary", "author", "image_url")},
        "published_at": _optional(s["published_at"], moment(s["published_at"]).isNotNull()),
    }


def request_violations(o: Column) -> Column:
    """Names of the rules that an opened request breaks; json if it is none."""
    own = {
        "job_id": is_text(o["job_id"], 1, 36), "requested_at": moment(o["requested_at"]).isNotNull(), "ingest": flag(o["ingest"]).isNotNull(),
        "requested_by": is_text(o["requested_by"], 1, 100),
    }
    return F.when(o.isNull(), F.array(F.lit("json"))).otherwise(F.array_sort(F.array_distinct(F.concat(_broken(own), _of_list(o, "feeds", _feed_rules)))))


def result_violations(o: Column) -> Column:
    """As request_violations, of a result."""
    own = {
        "job_id": is_text(o["job_id"], 1, 36), "ingest": flag(o["ingest"]).isNotNull(), "feed_id": is_number(o["feed_id"], 1), "feed_url": is_text(o["feed_url"], 1, 500),
        "status": F.coalesce((_kind(o["status"]) == "STRING") & _text(o["status"]).isin(STATUSES), F.lit(False)),
        "error_message": _optional(o["error_message"], is_text(o["error_message"])), "new_etag": _optional(o["new_etag"], is_text(o["new_etag"], 0, 255)),
        "new_last_update": _optional(o["new_last_update"], moment(o["new_last_update"]).isNotNull()), "fetchprotection": is_number(o["fetchprotection"], 0, PROTECTION_MAX),
    }
    return F.when(o.isNull(), F.array(F.lit("json"))).otherwise(F.array_sort(F.array_distinct(F.concat(_broken(own), _of_list(o, "sources", _entry_rules)))))


def request_columns(o: Column) -> list[Column]:
    """job_id, requested_at, ingest, requested_by, feeds of a request that breaks no rule (schemas.REQUEST)."""

    def feed(f: Column) -> Column:
        return F.struct(
            whole_number(f["feed_id"]).alias("feed_id"), _text(f["feed_url"]).alias("feed_url"), whole_number(f["company_id"]).alias("company_id"), _text(f["host_header"]).alias("host_header"),
            F.coalesce(whole_number(f["fetchprotection"]), F.lit(PROTECTION_DEFAULT)).cast("int").alias("fetchprotection"), _text(f["etag"]).alias("etag"),
            *(moment(f[name]).alias(name) for name in ("last_update", "last_db_article_published_at")),
        )

    feeds = F.transform(o["_items"], feed).alias("feeds")
    return [_text(o["job_id"]).alias("job_id"), moment(o["requested_at"]).alias("requested_at"), flag(o["ingest"]).alias("ingest"), _text(o["requested_by"]).alias("requested_by"), feeds]


def result_columns(o: Column) -> list[Column]:
    """Columns of a result that breaks no rule (schemas.RESULT)."""
    texts = ("title", "url", "summary", "author")
    entry = lambda s: F.struct(*(_text(s[n]).alias(n) for n in texts), moment(s["published_at"]).alias("published_at"), _text(s["image_url"]).alias("image_url"))
    text = lambda name: _text(o[name]).alias(name)
    return [
        text("job_id"), flag(o["ingest"]).alias("ingest"), whole_number(o["feed_id"]).alias("feed_id"), text("feed_url"), text("status"), text("error_message"), text("new_etag"),
        moment(o["new_last_update"]).alias("new_last_update"), whole_number(o["fetchprotection"]).cast("int").alias("fetchprotection"), F.transform(o["_items"], entry).alias("sources"),
    ]
