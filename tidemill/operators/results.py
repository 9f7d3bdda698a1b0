"""Scrape results: routing, classification, and the idempotent fold into tables.

Messages carry `seq`, their arrival order. A batch is folded per key before it meets a table, with values picked by
seq, so neither its partitioning nor its cutting into smaller batches changes the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.dates import parse_date
from tidemill.operators.reads import job_counts, job_status, status_of
from tidemill.operators.upsert import keep, upsert, with_ids
from tidemill.schemas import STREAM_CHECK, STREAM_ERROR, STREAM_INGEST, epoch, result_rules, violations


def route(status: Column, ingest: Column) -> Column:
    """The stream that a result goes to."""
    return F.when(status == "error", STREAM_ERROR).when(ingest, STREAM_INGEST).otherwise(STREAM_CHECK)


def queue_kind(stream: Column) -> Column:
    return F.when(stream == STREAM_CHECK, "check").when(stream == STREAM_INGEST, "ingest").otherwise("error")


def classify(responses: DataFrame, scraping: DataFrame) -> DataFrame:
    """responses(feed_id, status_code, etag, last_modified, parsed_last_modified, error, parse_error) against scrape
    state: feed_id, status, error_message, new_etag, new_last_update. The first rule that holds decides."""
    s = scraping.select("feed_id", F.col("fetchprotection").alias("_level"), F.col("etag").alias("_etag"), F.col("last_update").alias("_date"))
    r = responses.join(s, "feed_id", "left")
    blocked, failed = F.coalesce(F.col("_level") == 0, F.lit(False)), F.col("error").isNotNull()
    same = F.coalesce(F.col("last_modified") == F.col("_date"), F.lit(False)) | F.coalesce(F.col("etag") == F.col("_etag"), F.lit(False))
    unchanged, broken = (F.col("status_code") == 304) | same, F.col("parse_error").isNotNull()
    status = F.when(blocked | failed, "error").when(unchanged, "not_modified").when(broken, "error").otherwise("success")
    message = F.when(blocked, F.lit("Blocked by fetch protection")).when(failed, F.col("error")).when(unchanged, F.lit(None)).when(broken, F.concat(F.lit("Feed parse error: "), F.col("parse_error")))
    return r.select(
        "feed_id", status.alias("status"), message.alias("error_message"), F.when(~(blocked | failed), F.col("etag")).alias("new_etag"),
        F.when(blocked | failed, F.lit(None)).when(unchanged | broken, F.col("last_modified")).otherwise(F.coalesce("last_modified", "parsed_last_modified")).alias("new_last_update"),
    )


def response_columns(responses: DataFrame) -> DataFrame:
    """Crawled responses (schemas.RESPONSE) with etag and last_modified taken from the headers, whatever their case."""
    header = lambda name: F.element_at(F.map_filter("headers", lambda k, v: F.lower(k) == name), F.element_at(F.map_keys(F.map_filter("headers", lambda k, v: F.lower(k) == name)), 1))
    has = lambda name: F.exists(F.map_keys("headers"), lambda k: F.lower(k) == name)
    return responses.withColumn("etag", F.when(has("etag"), header("etag"))).withColumn("last_modified", parse_date(F.when(has("last-modified"), header("last-modified"))))


def split_valid(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that meet the rules of a result, and the rest with the names of the rules that they break."""
    marked = messages.withColumn("violations", violations(result_rules()))
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def new_results(messages: DataFrame, jobs: DataFrame, results: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """The first message of each (job, feed) whose job exists and that has no result yet (and whose feed exists)."""
    m = messages.join(jobs.select("job_id"), "job_id", "left_semi")
    if feeds is not None:
        m = m.join(feeds.select(F.col("id").alias("feed_id")), "feed_id", "left_semi")
    first = m.groupBy("job_id", "feed_id").agg(F.min_by(F.struct(*[c for c in m.columns if c not in ("job_id", "feed_id")]), "seq").alias("_m"))
    return first.select("job_id", "feed_id", "_m.*").join(results.select("job_id", "feed_id"), ["job_id", "feed_id"], "left_anti")


def fold_scraping(messages: DataFrame) -> DataFrame:
    """One row per feed: what a batch of results does to its scrape state."""
    failed = F.col("status") == "error"
    keyed = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return messages.groupBy("feed_id").agg(
        F.max_by("fetchprotection", "seq").alias("fetchprotection"), keyed("new_last_update").alias("last_update"), keyed("new_etag").alias("etag"),
        F.count_if(failed).cast("int").alias("error_nbr"), F.max_by(F.when(failed, F.col("error_message")), "seq").alias("error_msg"),
    )


def update_scraping(scraping: DataFrame, messages: DataFrame) -> DataFrame:
    """Scrape state after a batch: errors add up and never reset; the last message sets or clears the error's text."""
    rules = {"fetchprotection": "replace", "last_update": "coalesce", "etag": "coalesce", "error_nbr": "add", "error_msg": "replace"}
    return upsert(scraping, fold_scraping(messages), ["feed_id"], rules)


def fold_articles(messages: DataFrame) -> DataFrame:
    """messages with sources (from ingest streams, successful): one row per (url, published_at), and feed ids."""
    s = messages.filter((F.col("status") == "success") & (F.col("queue_kind") == "ingest")).select("feed_id", "seq", F.posexplode("sources").alias("pos", "s"))
    a = s.select("feed_id", F.struct("seq", "pos").alias("at"), "s.title", "s.url", "s.summary", "s.author", F.coalesce("s.published_at", epoch()).alias("published_at"), "s.image_url")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return a.groupBy("url", "published_at").agg(F.max_by("title", "at").alias("title"), last("summary"), last("author"), last("image_url"), F.collect_set("feed_id").alias("feed_ids"))


def week_of(published_at: Column) -> Column:
    """Start of the week; NULL (the default partition) for the epoch and before."""
    return F.when(published_at > epoch(), F.date_trunc("week", published_at).cast("timestamp_ntz"))


def changed_articles(articles: DataFrame, links: DataFrame, batch: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles after a folded batch, and links that it adds. New articles get ids in the order of (published_at, url), from
    the one in `last` (one row, one column) upwards."""
    keys = ["url", "published_at"]
    fresh = batch.join(articles.select(keys), keys, "left_anti")
    ids = with_ids(fresh.select(keys), ["published_at", "url"], last)
    known = articles.select("id", *keys).unionByName(ids.select("id", *keys))
    rules = {"title": "replace", "summary": "coalesce", "author": "coalesce", "image_url": "coalesce"}
    rows = batch.drop("feed_ids").join(ids, keys, "left")
    out = upsert(articles, rows, keys, rules).select(articles.columns)
    pairs = batch.select(*keys, F.explode("feed_ids").alias("feed_id")).join(known, keys).select(F.col("id").alias("source_id"), "feed_id", "published_at")
    return out, pairs.join(links.select("source_id", "feed_id", "published_at"), ["source_id", "feed_id", "published_at"], "left_anti")


def update_articles(articles: DataFrame, links: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles and links after a folded batch."""
    out, new = changed_articles(articles, links, batch, articles.agg(F.max("id").alias("id")))
    return out, links.select("source_id", "feed_id", "published_at").unionByName(new)


def add_counts(counts: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of jobs (job_id and those of reads.job_counts) with new results added; only these are counted."""
    columns = [c for c in job_counts(new).columns if c != "job_id"]
    return upsert(counts, job_counts(new), ["job_id"], dict.fromkeys(columns, "add"))


def with_status(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """jobs with the status that follows from their counters (which not all need have)."""
    c = counts.select("job_id", "feeds_processed", "feeds_error")
    n = lambda name: F.coalesce(name, F.lit(0))
    return jobs.join(c, "job_id", "left").withColumn("status", status_of(F.col("feed_count"), n("feeds_processed"), n("feeds_error"))).select(jobs.columns)


def persist(messages: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """job_results, scraping, articles, links and jobs after a batch of valid messages (with seq and stream_name).
    Messages that are not the first of their (job, feed) change nothing."""
    m = messages.withColumn("queue_kind", queue_kind(F.col("stream_name")))
    new = keep(new_results(m, tables["jobs"], tables["job_results"], tables.get("feeds")), "new")
    results = tables["job_results"].unionByName(new.select([c if c in new.columns else F.lit(None).alias(c) for c in tables["job_results"].columns]))
    out = {"job_results": results, "scraping": update_scraping(tables["scraping"], new), "jobs": job_status(tables["jobs"], results)}
    if "articles" in tables and "sources" in new.columns:
        out["articles"], out["links"] = update_articles(tables["articles"], tables["links"], fold_articles(new))
    return out
