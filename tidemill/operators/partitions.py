"""Weekly partitions of articles and links, and backfills from older table forms."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import clamp
from tidemill.operators.results import week_of
from tidemill.operators.upsert import keep
from tidemill.schemas import epoch


def week_starts(*tables: DataFrame) -> DataFrame:
    """Distinct week starts of all rows later than the epoch."""
    all_rows = tables[0].select("published_at")
    for t in tables[1:]:
        all_rows = all_rows.unionByName(t.select("published_at"))
    return all_rows.select(week_of(F.coalesce("published_at", epoch())).alias("week_start")).filter("week_start is not null").distinct()


def repartitioned(rows: DataFrame) -> DataFrame:
    """Rows with their week_start, NULL dates as the epoch; epoch and older rows stay in the default partition (NULL)."""
    filled = rows.withColumn("published_at", F.coalesce("published_at", epoch()))
    return filled.withColumn("week_start", week_of(F.col("published_at")))


def repartition_report(articles: DataFrame, links: DataFrame, weeks: DataFrame) -> DataFrame:
    """Before moving the default partition (rows with no week_start) of both tables: rows in it, week pairs to make
    (weeks: those there already; a pair is made whole, so this is the count of both tables), weeks covered in all."""
    d = lambda t: t.filter("week_start is null")
    starts = week_starts(articles)
    made = starts.join(weeks.select("week_start"), "week_start", "left_anti")
    counts = [d(articles).agg(F.count("*").alias("articles_in_default")), d(links).agg(F.count("*").alias("links_in_default")), made.agg(F.count("*").alias("weeks_made")), starts.agg(F.count("*").alias("weeks_covered"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


def repartition_counters(articles: DataFrame, links: DataFrame, article_weeks: DataFrame, link_weeks: DataFrame) -> DataFrame:
    """The five counters of moving the default partition: rows of both tables in it, weekly partitions that each table
    lacks (of those in article_weeks and link_weeks), and weeks of all articles."""
    inside = lambda t, name: t.agg(F.count_if(F.col("week_start").isNull()).alias(name))
    starts = keep(week_starts(articles), "weeks")
    made = lambda weeks, name: starts.join(weeks.select("week_start"), "week_start", "left_anti").agg(F.count("*").alias(name))
    counts = [inside(links, "links_in_default"), made(article_weeks, "article_weeks_made"), made(link_weeks, "link_weeks_made"), starts.agg(F.count("*").alias("weeks_covered"))]
    out = inside(articles, "articles_in_default")
    for c in counts:
        out = out.crossJoin(c)  # one row each
    return out


def write_weeks(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Add rows to a table partitioned by week_start; those whose key (default: id, published_at) is in their partition
    already are left out, so a second run adds nothing."""
    keys = [*(keys or ["id", "published_at"]), "week_start"]
    new = repartitioned(rows).dropDuplicates(keys)
    try:
        weeks = [r.week_start for r in new.select("week_start").distinct().collect()]  # the partitions that the rows go to
        of_week = F.col("week_start").isin([w for w in weeks if w is not None]) | (F.col("week_start").isNull() if None in weeks else F.lit(False))
        there = rows.sparkSession.read.schema(new.schema).parquet(path).filter(of_week).select(*[F.col(k).alias(f"_{k}") for k in keys])
        new = new.join(there, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.mode("append").partitionBy("week_start").parquet(path)


def migrate_articles(old: DataFrame, to_epoch: bool = True) -> DataFrame:
    """NULL dates as the epoch, or back."""
    date = F.coalesce("published_at", epoch()) if to_epoch else F.nullif("published_at", epoch())
    return old.withColumn("published_at", date)


def migrate_links(old: DataFrame, articles: DataFrame) -> DataFrame:
    """Links (source_id, feed_id) with the date of their article, each once; links without article go."""
    dates = articles.select(F.col("id").alias("source_id"), F.coalesce("published_at", epoch()).alias("published_at"))
    return old.select("source_id", "feed_id").distinct().join(dates, "source_id").select("source_id", "feed_id", "published_at")


def split_scraping(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feeds of the old form, which held the scrape state: (feeds, scrape state)."""
    state = [c for c in ("fetchprotection", "last_update", "etag", "error_nbr", "error_msg") if c in feeds.columns]
    return feeds.drop(*state), feeds.select(F.col("id").alias("feed_id"), *[clamp(F.col(c)).alias(c) if c == "fetchprotection" else F.col(c) for c in state])
