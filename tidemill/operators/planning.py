"""Scrape planning: payloads, round-robin order, batches, request headers, send slots, job rows."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.dates import http_date
from tidemill.functions.text import clean, company_key, effective_protection, host
from tidemill.operators.reads import with_ids
from tidemill.operators.upsert import keep
from tidemill.operators.upsert import with_ids as numbered_by_range
from tidemill.schemas import JOB

log = logging.getLogger(__name__)

#: Headers of a browser, sent at the highest level of fetch protection (fixed values, which must not differ).
BROWSER_HEADERS = {
    "User-Agent": "Mozilla/5.0 (X11; Linux x86_64; rv:140.0) Gecko/20100101 Firefox/140.0",
    "Accept-Language": "en-US,en;q=0.9,fr;q=0.8",
    "Accept": "application/rss+xml, application/atom+xml, application/xml;q=0.9, text/xml;q=0.8, */*;q=0.5",
    "Accept-Encoding": "gzip, deflate, br",
    "Cache-Control": "no-cache",
    "Connection": "keep-alive",
    "Pragma": "no-cache",
}


def payloads(feeds: DataFrame, companies: DataFrame, scraping: DataFrame, articles: DataFrame, links: DataFrame, ids=None, enabled_only: bool = True) -> DataFrame:
    """One row per feed: what a scraper needs to know, with the date of the feed's latest article."""
    latest = links.join(articles.select(F.col("id").alias("source_id"), "published_at"), ["source_id", "published_at"], "left_semi").groupBy("feed_id").agg(F.max("published_at").alias("latest"))
    c = companies.select(F.col("id").alias("company_id"), "host", F.col("fetchprotection").alias("of_company"))
    s = scraping.select("feed_id", F.col("fetchprotection").alias("own"), "etag", "last_update")
    f = with_ids(feeds.filter("enabled") if enabled_only else feeds, "id", ids).withColumnRenamed("id", "feed_id")
    out = f.join(s, "feed_id", "left").join(c, "company_id", "left").join(latest, "feed_id", "left")
    return out.select("feed_id", F.col("url").alias("feed_url"), "company_id", host(F.col("host")).alias("host_header"), effective_protection(F.col("own"), F.col("of_company")).alias("fetchprotection"), "etag", "last_update", F.col("latest").alias("last_db_article_published_at"))


def _zero(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(0).alias("last"))


def round_robin(feeds: DataFrame, order: str = "feed_id") -> DataFrame:
    """feeds with turn (nth of its company) and company_first (the company's first feed): sort by both to have the nth
    feed of every company before any (n+1)th, companies as they first appear. Feeds without company stand alone. Feeds
    are ranked over range parts, so a company of any size is spread."""
    ranked = numbered_by_range(feeds.withColumn("_key", company_key(F.col("company_id"), F.col("feed_id"))), ["_key", order], _zero(feeds), "_rank")
    first = ranked.groupBy("_key").agg(F.min("_rank").alias("_first"), F.min(order).alias("company_first"))
    out = ranked.join(first, "_key").withColumn("turn", (F.col("_rank") - F.col("_first") + 1).cast("int"))
    return out.select(*feeds.columns, "turn", "company_first")


def in_batches(feeds: DataFrame, size: int = 50) -> DataFrame:
    """Round-robin feeds with position (from 1) and batch (from 0), numbered over range parts as well."""
    numbered = numbered_by_range(round_robin(feeds), ["turn", "company_first"], _zero(feeds), "position")
    return numbered.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))


def request_headers(level: Column, host_name: Column, etag: Column, last_update: Column) -> Column:
    """map<string,string> of a request, NULL when there is nothing to send."""
    none = F.create_map().cast("map<string,string>")
    strong = F.coalesce(level >= 2, F.lit(False))
    browser = F.create_map(*(F.lit(x) for pair in BROWSER_HEADERS.items() for x in pair))
    h = host(host_name)
    own = F.create_map(F.lit("Host"), h, F.lit("Origin"), F.concat(F.lit("https://"), h), F.lit("Referer"), F.concat(F.lit("https://"), h, F.lit("/")))
    parts = [
        F.when(strong, browser).otherwise(none),
        F.when(strong & h.isNotNull(), own).otherwise(none),
        F.when(clean(etag).isNotNull(), F.create_map(F.lit("If-None-Match"), clean(etag))).otherwise(none),
        F.when(last_update.isNotNull(), F.create_map(F.lit("If-Modified-Since"), http_date(last_update))).otherwise(none),
    ]
    m = F.map_concat(*parts)
    return F.when(F.size(m) > 0, m)


def send_slots(planned: DataFrame, per_second: int = 4) -> DataFrame:
    """Seconds after the start at which each planned request is sent: so many a second for each company of a job."""
    keyed = planned.withColumn("_key", company_key(F.col("company_id"), F.col("feed_id")))
    ranked = numbered_by_range(keyed, ["job_id", "_key", "feed_id"], _zero(planned), "_rank")
    first = ranked.groupBy("job_id", "_key").agg(F.min("_rank").alias("_first"))
    slot = F.floor((F.col("_rank") - F.col("_first")) / per_second).cast("long").alias("send_slot")
    return ranked.join(first, ["job_id", "_key"]).select(*[ranked[c] for c in planned.columns], slot)


FREE = "company_key string, free array<long>"


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def send_times(requests: DataFrame, state: DataFrame, per_second: int = 4, part: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """requests(company_id, feed_id, arrived) of one batch with sent_at, and the state after it. Of a company at most
    per_second requests are sent in any second, in the order of (arrived, feed_id): each waits for the one per_second places before it
    and a second more. state (FREE): when each of a company's places is free again, in microseconds; companies it does not know
    are free. A batch arrives after the one before.

    A place is a chain of every per_second-th request, along which sent = max(arrived, sent before + 1): the largest so far of
    (arrived - steps), plus the steps. These maxima are taken within parts of `part` ranks and then over the parts, so a company of any size is spread."""
    second = 1_000_000
    keyed = requests.withColumn("company_key", company_key(F.col("company_id"), F.col("feed_id"))).withColumn("_at", _micros(F.col("arrived")))
    ranked = numbered_by_range(keyed, ["company_key", "_at", "feed_id"], _zero(requests), "_rank")
    first = ranked.groupBy("company_key").agg(F.min("_rank").alias("_first"))
    nth = F.col("_rank") - F.col("_first")
    placed = ranked.join(first, "company_key").withColumn("_chain", (nth % per_second).cast("int")).withColumn("_step", F.floor(nth / per_second) * second).withColumn("_part", F.floor(F.col("_rank") / part))
    placed = placed.withColumn("_value", F.col("_at") - F.col("_step"))
    keys = ["company_key", "_chain"]
    of_part = placed.groupBy(*keys, "_part").agg(F.max("_value").alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    before = of_part.withColumn("_before", F.max("_m").over(earlier)).drop("_m")
    free = state.select("company_key", F.posexplode(F.array_sort("free")).alias("_chain", "_free"))
    within = Window.partitionBy(*keys, "_part").orderBy("_rank")
    out = placed.join(before, [*keys, "_part"]).join(free, keys, "left")
    out = keep(out.withColumn("_sent", F.greatest(F.max("_value").over(within), "_before", "_free") + F.col("_step")), "sent")
    last = out.groupBy(*keys).agg((F.max("_sent") + second).alias("_next"))
    after = free.join(last, keys, "full_outer").groupBy("company_key").agg(F.array_sort(F.collect_list(F.coalesce("_next", "_free"))).alias("free"))  # per_second values
    sent_at = F.timestamp_add("MICROSECOND", F.col("_sent"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("sent_at")
    return out.select(*requests.columns, sent_at), after


def plan_jobs(planned: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(job_id, ingest, requested_by, requested_at) and their planned feeds: rows of jobs and of job feeds."""
    feeds = planned.select("job_id", "feed_id", "feed_url", "last_db_article_published_at")
    counts = feeds.groupBy("job_id").agg(F.count("*").cast("int").alias("feed_count"))
    jobs = requests.join(counts, "job_id", "left").na.fill(0, ["feed_count"])
    jobs = jobs.withColumn("status", F.when(F.col("feed_count") == 0, "completed").otherwise("queued")).withColumn("updated_at", F.col("requested_at"))
    return jobs.select([x.split()[0] for x in JOB.split(", ")]), feeds


def request_messages(batches: DataFrame) -> DataFrame:
    """One JSON payload per batch of a job (batches hold `size` feeds at most)."""
    feed = F.struct("position", "feed_id", "feed_url", "company_id", "host_header", "fetchprotection", "etag", "last_update", "last_db_article_published_at")
    grouped = batches.groupBy("job_id", "requested_at", "ingest", "requested_by", "batch").agg(F.array_sort(F.collect_list(feed)).alias("feeds"))
    feeds = F.transform("feeds", lambda x: x.dropFields("position"))
    return grouped.select("job_id", "batch", F.to_json(F.struct("job_id", "requested_at", "ingest", "requested_by", feeds.alias("feeds"))).alias("payload"))


def publish(jobs: DataFrame, batches: DataFrame, send: Callable[[DataFrame], None]) -> DataFrame:
    """Send the request messages; returns jobs as they are or, where sending fails, those with feeds as failed."""
    try:
        send(request_messages(batches))
    except Exception:  # whatever the sink raises; the jobs must not stay queued
        log.exception("Requests were not sent")
        return jobs.withColumn("status", F.when(F.col("feed_count") > 0, "failed").otherwise(F.col("status")))
    return jobs
