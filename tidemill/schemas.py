"""Schemas of tables, payloads and catalog files, and the rules that payloads must meet.

All times are TIMESTAMP_NTZ in UTC. Articles and links have 1970-01-01 for a missing published_at, as it is part of
their key; everywhere else it is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
EPOCH = "1970-01-01 00:00:00"
PROTECTION_DEFAULT, PROTECTION_MAX = 1, 2
STATUSES = ["success", "not_modified", "error"]
JOB_STATUSES = ["queued", "processing", "completed", "completed_with_errors", "failed"]
STREAM_CHECK, STREAM_INGEST, STREAM_ERROR, STREAM_REQUEST = "rss_check_results", "rss_ingest_results", "error_feeds_parsing", "rss_scrape_requests"

COMPANY = "id long, name string, host string, icon_url string, country string, language string, fetchprotection int, enabled boolean"
FEED = "id long, url string, section string, enabled boolean, trust_score double, company_id long"
TAG = "id long, name string"
FEED_TAG = "feed_id long, tag_id long"
SCRAPING = "feed_id long, fetchprotection int, last_update timestamp_ntz, etag string, error_nbr int, error_msg string"
ARTICLE = "id long, title string, summary string, author string, url string, published_at timestamp_ntz, image_url string"
LINK = "source_id long, feed_id long, published_at timestamp_ntz"
JOB = "job_id string, ingest boolean, requested_by string, requested_at timestamp_ntz, feed_count int, status string, updated_at timestamp_ntz"
JOB_FEED = "job_id string, feed_id long, feed_url string, last_db_article_published_at timestamp_ntz"
JOB_RESULT = "job_id string, feed_id long, status string, queue_kind string, error_message string, fetchprotection int, new_etag string, new_last_update timestamp_ntz, processed_at timestamp_ntz"

ENTRY = "title string, url string, summary string, author string, published_at timestamp_ntz, image_url string"
REQUEST = "job_id string, requested_at timestamp_ntz, ingest boolean, requested_by string, feeds array<struct<feed_id:long,feed_url:string,company_id:long,host_header:string,fetchprotection:int,etag:string,last_update:timestamp_ntz,last_db_article_published_at:timestamp_ntz>>"
RESULT = "job_id string, ingest boolean, feed_id long, feed_url string, status string, error_message string, new_etag string, new_last_update timestamp_ntz, fetchprotection int, sources array<struct<title:string,url:string,summary:string,author:string,published_at:timestamp_ntz,image_url:string>>"
RESPONSE = "feed_id long, status_code int, headers map<string,string>, body string, error string"
CATALOG = "company string, host string, img string, country string, language string, fetchprotection int, feeds array<struct<url:string,title:string,tags:array<string>,enabled:boolean,trust_score:double,fetchprotection:int>>"


def epoch() -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz")


def text_between(column: str, least: int, most: int, required: bool = True) -> Column:
    """True where the text has an allowed length; NULL is allowed unless required."""
    size = F.length(column).between(least, most)
    return F.coalesce(size, F.lit(False)) if required else F.coalesce(size, F.lit(True))


def number_between(column: str, least: int, most: int | None = None, required: bool = True) -> Column:
    """As text_between, for numbers; texts that hold a number are numbers."""
    value = F.col(column).try_cast("bigint")
    ok = (value >= least) if most is None else value.between(least, most)
    return F.coalesce(ok, F.lit(False)) if required else F.coalesce(ok, F.col(column).isNull())


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))


def result_rules() -> dict[str, Column]:
    """Rules of a scrape result (columns of RESULT, which may still be texts)."""
    return {
        "job_id": text_between("job_id", 1, 36),
        "feed_id": number_between("feed_id", 1),
        "feed_url": text_between("feed_url", 1, 500),
        "status": F.coalesce(F.col("status").isin(STATUSES), F.lit(False)),
        "new_etag": text_between("new_etag", 0, 255, required=False),
        "fetchprotection": number_between("fetchprotection", 0, PROTECTION_MAX, required=False),
    }


def request_rules() -> dict[str, Column]:
    """Rules of one feed of a scrape request, with the request's own columns beside it."""
    return {
        "job_id": text_between("job_id", 1, 36),
        "requested_by": text_between("requested_by", 1, 100, required=False),
        "feed_id": number_between("feed_id", 1),
        "feed_url": text_between("feed_url", 1, 500),
        "host_header": text_between("host_header", 1, 255, required=False),
        "fetchprotection": number_between("fetchprotection", 0, PROTECTION_MAX),
        "etag": text_between("etag", 0, 255, required=False),
    }


def entry_rules() -> dict[str, Column]:
    """Rules of an article entry."""
    return {"title": text_between("title", 1, 1 << 30), "url": text_between("url", 1, 1000)}
