"""Read models: feeds, articles, jobs and facets.

Pages are cut on narrow ids first; wide rows join afterwards. Only what is bounded by a page or a parameter list is
broadcast; other joins are left to the optimiser, which broadcasts by measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import company_names, effective_protection, feed_label, trust_percent
from tidemill.operators.upsert import keep
from tidemill.schemas import STATUSES, epoch

SHORT_LIST = 1000


def with_ids(df: DataFrame, key: str, ids: Sequence[int] | DataFrame | None, positive: bool = True) -> DataFrame:
    """Rows whose key is among ids: none given, no filter; nothing left of them, no rows."""
    if ids is None or not isinstance(ids, DataFrame) and not len(ids):
        return df
    if isinstance(ids, DataFrame):
        wanted = ids.toDF(key).distinct()
        return df.join(wanted.filter(F.col(key) > 0) if positive else wanted, key, "left_semi")
    kept = sorted({int(i) for i in ids if i is not None and (i > 0 or not positive)})
    if len(kept) <= SHORT_LIST:
        return df.filter(F.col(key).isin(kept)) if kept else df.filter(F.lit(False))
    return df.join(df.sparkSession.createDataFrame([(i,) for i in kept], f"{key} long"), key, "left_semi")


def feed_list(feeds: DataFrame, companies: DataFrame, scraping: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Feeds with their effective protection and their company as a struct (NULL without one), by id."""
    c = companies.select(F.col("id").alias("company_id"), F.struct(*(F.col(x) for x in companies.columns)).alias("company"))
    s = scraping.select(F.col("feed_id").alias("id"), F.col("fetchprotection").alias("own"))
    out = with_ids(feeds, "id", ids, positive=False).join(s, "id", "left").join(c, "company_id", "left")
    return out.select("id", "url", "section", "enabled", "trust_score", effective_protection(F.col("own"), F.col("company.fetchprotection")).alias("fetchprotection"), "company").orderBy("id")


def enabled_feeds(feeds: DataFrame, scraping: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Enabled feeds that are not blocked (level 0), by id."""
    s = scraping.select(F.col("feed_id").alias("id"), F.col("fetchprotection").alias("level"))
    out = with_ids(feeds.filter("enabled"), "id", ids).join(s, "id", "left").filter(F.coalesce("level", F.lit(1)) != 0)
    return out.select(*feeds.columns, F.coalesce("level", F.lit(1)).alias("fetchprotection")).orderBy("id")


def feeds_by_urls(feeds: DataFrame, urls: DataFrame) -> DataFrame:
    """Feeds whose url is among urls (one column)."""
    return feeds.join(urls.toDF("url").distinct(), "url", "left_semi").select(feeds.columns)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup."""
    return df.filter(F.col(key) == value)


def feed_tags(feeds: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """feed_id, tags: sorted names of the feed's tags."""
    named = links.join(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")), "tag_id")
    return feeds.select(F.col("id").alias("feed_id")).join(named, "feed_id").groupBy("feed_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def search_feeds(feeds: DataFrame, query: str = "", enabled: bool | None = None, sort: str = "trust_desc") -> DataFrame:
    """Feeds by state and by a part of url or section (any case), in one of four orders."""
    order = {"trust_desc": F.desc("trust_score"), "trust_asc": F.asc("trust_score"), "url_asc": F.asc("url"), "url_desc": F.desc("url")}[sort]
    out = feeds if enabled is None else feeds.filter(F.col("enabled") == enabled)
    if query.strip():
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "url", "section")), F.lit(query.strip().lower())))
    return out.orderBy(order, "id")


def latest_dates(articles: DataFrame, links: DataFrame, feeds: DataFrame, feed_id: int | None = None, company_id: int | None = None) -> DataFrame:
    """source_id, latest: of linked articles, those of one feed or company if given."""
    own = feeds.select(F.col("id").alias("feed_id"), "company_id")
    if feed_id is not None:
        own = own.filter(F.col("feed_id") == feed_id)
    if company_id is not None:
        own = own.filter(F.col("company_id") == company_id)
    keys = ["source_id", "published_at"] + [c for c in ("week_start",) if c in articles.columns and c in links.columns]
    a = articles.select(F.col("id").alias("source_id"), *keys[1:])
    l = links.select("feed_id", *keys)  # noqa: E741
    if feed_id is not None:
        l = l.filter(F.col("feed_id") == feed_id)  # noqa: E741
    return l.join(own.select("feed_id"), "feed_id", "left_semi").join(a, keys).groupBy("source_id").agg(F.max("published_at").alias("latest"))


def details(ids: DataFrame, articles: DataFrame, links: DataFrame, feeds: DataFrame, companies: DataFrame) -> DataFrame:
    """The articles of ids (a bounded frame with a column source_id) with sorted company names and feed sections of all
    their links; epoch dates as NULL."""
    ids = F.broadcast(ids.select("source_id"))
    f = feeds.select(F.col("id").alias("feed_id"), "section", "company_id")
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    l = links.select("source_id", "feed_id").join(ids, "source_id").join(f, "feed_id", "left").join(c, "company_id", "left")  # noqa: E741
    named = l.groupBy("source_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("company") != "", F.col("company")))).alias("company_names"),
        F.array_sort(F.collect_set(F.when(F.col("section") != "", F.col("section")))).alias("feed_sections"),
    )
    a = articles.withColumnRenamed("id", "source_id").join(ids, "source_id")
    latest = a.groupBy("source_id").agg(F.max_by(F.struct("title", "summary", "author", "url", "published_at", "image_url"), "published_at").alias("a")).select("source_id", "a.*")
    empty = F.array().cast("array<string>")
    return latest.join(named, "source_id", "left").select(
        F.col("source_id").alias("id"), "title", "summary", "author", "url", F.nullif("published_at", epoch()).alias("published_at"), "image_url",
        F.coalesce("company_names", empty).alias("company_names"), F.coalesce("feed_sections", empty).alias("feed_sections"),
    )


def article_page(articles: DataFrame, links: DataFrame, feeds: DataFrame, companies: DataFrame, limit: int = 50, offset: int = 0, feed_id: int | None = None, company_id: int | None = None) -> DataFrame:
    """One page of articles, newest first; those without a date last, then by id from the highest."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    dates = latest_dates(articles, links, feeds, feed_id, company_id)
    # at most 100 rows, which three joins use
    return page_details(keep(dates.orderBy(F.desc_nulls_last("latest"), F.desc("source_id")).offset(offset).limit(limit), "page"), articles, links, feeds, companies)


def page_details(page: DataFrame, articles: DataFrame, links: DataFrame, feeds: DataFrame, companies: DataFrame) -> DataFrame:
    """The articles of a page (source_id, latest), in its order."""
    out = details(page, articles, links, feeds, companies).drop("feed_sections")
    return out.join(F.broadcast(page.select(F.col("source_id").alias("id"), "latest")), "id").orderBy(F.desc_nulls_last("latest"), F.desc("id")).drop("latest")


def article_total(articles: DataFrame, links: DataFrame, feeds: DataFrame, feed_id: int | None = None, company_id: int | None = None) -> DataFrame:
    return latest_dates(articles, links, feeds, feed_id, company_id).agg(F.count("*").alias("total"))


def article_detail(articles: DataFrame, links: DataFrame, feeds: DataFrame, companies: DataFrame, source_id: int) -> DataFrame:
    """One article (no row if there is none), with or without links."""
    one = articles.filter(F.col("id") == source_id).select(F.col("id").alias("source_id")).distinct()
    return details(one, articles.filter(F.col("id") == source_id), links.filter(F.col("source_id") == source_id), feeds, companies)


def latest_by_url(articles: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """The newest article of each url (ties: the highest id)."""
    a = articles if urls is None else articles.join(urls.toDF("url").distinct(), "url", "left_semi")
    rest = [c for c in articles.columns if c != "url"]
    return a.groupBy("url").agg(F.max_by(F.struct(*rest), F.struct("published_at", "id")).alias("a")).select("url", "a.*").select(articles.columns)


def job_feed_reads(job_feeds: DataFrame, results: DataFrame, job_id: str | None = None) -> DataFrame:
    """Feeds of jobs with the state of each; pending without a result."""
    j = job_feeds if job_id is None else job_feeds.filter(F.col("job_id") == job_id)
    r = results.select("job_id", "feed_id", "status", "error_message")
    return j.join(r, ["job_id", "feed_id"], "left").withColumn("status", F.coalesce("status", F.lit("pending"))).orderBy("job_id", "feed_id")


def job_counts(results: DataFrame) -> DataFrame:
    """Per job: results in all and by status."""
    return results.groupBy("job_id").agg(F.count("*").alias("feeds_processed"), *(F.count_if(F.col("status") == s).alias(f"feeds_{s}") for s in STATUSES))


def job_status(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs with counts and status."""
    out = jobs.drop("status").join(job_counts(results), "job_id", "left").na.fill(0, ["feeds_processed", *(f"feeds_{s}" for s in STATUSES)])
    return out.withColumn("status", status_of(F.col("feed_count"), F.col("feeds_processed"), F.col("feeds_error")))


def status_of(feeds: Column, processed: Column, errors: Column) -> Column:
    return F.when(feeds == 0, "completed").when(processed == 0, "queued").when(processed < feeds, "processing").when(errors > 0, "completed_with_errors").otherwise("completed")


def company_facets(feeds: DataFrame, companies: DataFrame) -> DataFrame:
    """Feeds by company: name, number of feeds; most first, then by name."""
    c = companies.select(F.col("id").alias("company_id"), "name")
    trimmed = F.trim("name")
    label = F.when(F.col("name").isNull(), "Unknown").when(trimmed == "", "unknown").otherwise(trimmed)
    return feeds.join(c, "company_id", "left").groupBy(label.alias("company")).agg(F.count("*").alias("feeds"), F.count_if("enabled").alias("enabled_feeds")).orderBy(F.desc("feeds"), "company")


def company_options(feeds: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies that have feeds: id, name, by name."""
    used = feeds.select(F.col("company_id").alias("id")).distinct()
    return companies.select("id", "name").join(used, "id", "left_semi").orderBy("name", "id")


def error_digest(results: DataFrame, most: int = 3) -> DataFrame:
    """Per job with errors: how many, and the first messages by feed. The window's limit is applied before rows are
    shuffled, so a job sends `most` rows a task at most."""
    errors = results.filter("status = 'error'")
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("feed_id"))
    first = errors.withColumn("n", n).filter(F.col("n") <= most).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("feed_id", "error_message"))).alias("e"))
    return errors.groupBy("job_id").agg(F.count("*").alias("errors")).join(first.select("job_id", F.transform("e", lambda x: x["error_message"]).alias("messages")), "job_id")


def feed_labels(feeds: DataFrame, companies: DataFrame) -> DataFrame:
    c = companies.select(F.col("id").alias("company_id"), "name")
    names = F.array_compact(F.array("name"))
    return feeds.join(c, "company_id", "left").select("id", feed_label(F.col("id"), F.col("name"), F.col("section")).alias("label"), company_names(names).alias("companies"), trust_percent(F.col("trust_score")).alias("trust_percent"))
