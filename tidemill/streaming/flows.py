"""The two streams: requests to results, and results to tables.

Delivery is at least once; results are inserted once per (job, feed), and all tables of a batch become current in one
commit that names the batch, so a replay changes nothing, wherever the run before it stopped. The tables are the state,
and live as units of base and delta files below a folder (operators.delta): a batch reads the units of its own keys and
writes the rows that it changes. Messages are folded in the order of their log, so its cutting into batches changes nothing.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemill import schemas
from tidemill.operators import delta
from tidemill.operators.parse import normalize, parse_bodies, spoiled_feeds
from tidemill.operators.reads import job_counts
from tidemill.operators.results import add_counts, changed_articles, classify, fold_articles, new_results, queue_kind, response_columns, update_scraping, with_status
from tidemill.operators.upsert import commit, keep, last_commit, read_version, write_version
from tidemill.sources.messages import REQUESTS_A_BATCH, RESULTS_A_BATCH, read_requests, read_results, split_requests, split_results, write_results


def results_of(requests: DataFrame, responses: DataFrame, scraping: DataFrame, floor: str = "2026-01-01 00:00:00") -> DataFrame:
    """requests (one row per feed) with the outcome of each as schemas.RESULT."""
    wanted = requests.select("job_id", "ingest", "feed_id", "feed_url", "fetchprotection")
    got = response_columns(responses.join(wanted.select("feed_id").distinct(), "feed_id", "left_semi"))
    parsed, bodies = parse_bodies(got.select("feed_id", "body"))
    raw = wanted.select("job_id", "feed_id").join(parsed, "feed_id")
    entries = normalize(raw, floor)
    spoiled = spoiled_feeds(entries).select("job_id", "feed_id", F.col("error_message").alias("spoiled"))
    flat = got.join(bodies.withColumnRenamed("last_modified", "parsed_last_modified").withColumnRenamed("error", "parse_error"), "feed_id", "left")
    state = scraping.select("feed_id", "etag", "last_update").join(wanted.groupBy("feed_id").agg(F.min("fetchprotection").alias("fetchprotection")), "feed_id", "right")
    outcome = classify(flat.select("feed_id", "status_code", "etag", "last_modified", "parsed_last_modified", "error", "parse_error"), state)
    entry = F.struct("entry_pos", "title", "url", "summary", "author", "published_at", "image_url")
    sources = entries.groupBy("job_id", "feed_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("entry_pos")).alias("sources"))
    out = wanted.join(outcome, "feed_id", "left").join(sources, ["job_id", "feed_id"], "left").join(spoiled, ["job_id", "feed_id"], "left")
    missing, broken = F.col("status").isNull(), F.col("spoiled").isNotNull() & (F.col("status") == "success")
    none = F.array().cast("array<struct<title:string,url:string,summary:string,author:string,published_at:timestamp_ntz,image_url:string>>")
    return out.select(
        "job_id", "ingest", "feed_id", "feed_url", F.when(missing | broken, "error").otherwise(F.col("status")).alias("status"),
        F.when(missing, "No response").when(broken, F.col("spoiled")).otherwise(F.col("error_message")).alias("error_message"), "new_etag", "new_last_update", "fetchprotection",
        F.when((F.col("status") == "success") & ~broken, F.coalesce("sources", none)).otherwise(none).alias("sources"),
    )


def group_of(checkpoint: str) -> str:
    """The log's group that reads for a checkpoint."""
    return f"{zlib.crc32(checkpoint.encode()):08x}"


def run_batches(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.trigger(processingTime="5 seconds").start()
    query = writer.trigger(processingTime="0 seconds").start()  # batch by batch, as sources admit, until nothing is left
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def scrape(
    spark: SparkSession, requests: str, responses: Callable[[], DataFrame], scraping: Callable[[], DataFrame], out: str, checkpoint: str, quarantine: str,
    floor: str = "2026-01-01 00:00:00", available_now: bool = False, start: str = "latest", most: int | None = REQUESTS_A_BATCH,
) -> StreamingQuery:
    """Requests from a log to a log of results; refused ones go to quarantine, one folder per batch. A batch counts as
    read only once its results are out."""

    def batch(df: DataFrame, number: int) -> None:
        valid, refused = split_requests(df)
        refused.write.mode("overwrite").json(f"{quarantine}/batch={group_of(checkpoint)}-{number}")
        write_results(results_of(valid, responses(), scraping(), floor), out)

    return run_batches(read_requests(spark, requests, group_of(checkpoint), most, start), batch, checkpoint, available_now)


def create_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """The first content of feeds and of the tables of delta.LAYOUTS. Counters of jobs follow from the results."""
    spark = tables["feeds"].sparkSession
    delta.create(folder, {name: df for name, df in tables.items() if name != "feeds"} | {"job_counts": job_counts(tables["job_results"])})
    largest = tables["articles"].agg(F.max("id")).first()[0] or 0
    versions = {"feeds": write_version(tables["feeds"], f"{folder}/feeds", point=False)}
    commit(spark, folder, versions, change=lambda new: new.setdefault("values", {}).update(article_id=largest))


def changes(spark: SparkSession, results: DataFrame, folder: str, at: dict, feeds: DataFrame | None = None, seen: bool = False) -> dict[str, DataFrame]:
    """What a batch of valid results (schemas.RESULT, seq, stream_name) changes in the tables as of a commit: for each table the
    rows that are new or different. Of each table only the units and rows of the batch's own keys are read. seen: the results
    are known to be the first of their (job, feed), with the errors of their feed so far in error_nbr."""
    now = lambda name, keys: delta.read(spark, folder, name, keys, at)
    m = results.withColumn("queue_kind", queue_kind(F.col("stream_name"))).withColumn("processed_at", F.localtimestamp())
    jobs = keep(now("jobs", m.select("job_id")), "jobs")
    known = now("job_results", m.select("job_id", "feed_id")) if not seen else spark.createDataFrame([], schemas.JOB_RESULT)
    new = keep(new_results(m, jobs, known, feeds), "new")
    scraping = update_scraping(now("scraping", new.select("feed_id")), new)
    if seen:  # the state has counted the errors
        scraping = scraping.drop("error_nbr").join(new.groupBy("feed_id").agg(F.max("error_nbr").cast("int").alias("error_nbr")), "feed_id")
    counts = keep(add_counts(now("job_counts", new.select("job_id")), new), "counts")
    articles = keep(fold_articles(new), "articles")
    dates = articles.select("published_at", F.explode("feed_ids").alias("feed_id"))
    last = spark.range(1).select(F.lit(at["values"]["article_id"]).cast("long").alias("id"))
    changed, links = changed_articles(now("articles", articles.select("url", "published_at")), now("links", dates), articles, last)
    touched = jobs.join(new.select("job_id").distinct(), "job_id", "left_semi")
    return {"job_results": new, "scraping": scraping, "job_counts": counts, "jobs": with_status(touched, counts), "articles": changed, "links": links}


def persist_batch(spark: SparkSession, messages: DataFrame, tables: str, quarantine: str, batch: tuple[str, int] = ("", -1)) -> dict | None:
    """Decode, validate and fold one batch of messages (payload, seq, stream_name) into the tables; the commit. batch: its source
    and number; a batch that is committed is skipped, and messages in quarantine are those of the batch's last run."""
    if done(spark, tables, batch):
        return None
    valid, refused = split_results(messages)
    return persist_checked(spark, valid, refused, tables, quarantine, batch)


def done(spark: SparkSession, tables: str, batch: tuple[str, int]) -> bool:
    return 0 <= batch[1] <= last_commit(spark, tables)["batches"].get(batch[0], -1)


def persist_checked(spark: SparkSession, valid: DataFrame, refused: DataFrame, tables: str, quarantine: str, batch: tuple[str, int], seen: bool = False) -> dict:
    source, number = batch
    name = f"{zlib.crc32(source.encode()):08x}-{number}" if number >= 0 else uuid.uuid4().hex
    refused.write.mode("overwrite").json(f"{quarantine}/batch={name}")
    return persist_valid(spark, valid, tables, batch, seen)


def persist_valid(spark: SparkSession, valid: DataFrame, tables: str, batch: tuple[str, int], seen: bool = False) -> dict:
    """Commit what valid results (schemas.RESULT, seq, stream_name) change."""
    at = last_commit(spark, tables)
    after = changes(spark, valid, tables, at, read_version(spark, f"{tables}/feeds", schemas.FEED), seen)
    with ThreadPoolExecutor() as pool:  # the tables' writes do not wait for each other
        writes = {n: pool.submit(delta.stage, df, tables, n, delta.LAYOUTS[n], at["number"] + 1) for n, df in after.items()}
        staged = {n: w.result() for n, w in writes.items()}
    entries = [f"{tables}/articles/{e[0]}/_unit={u}" for u, e in staged["articles"].items()]
    largest = spark.read.schema("id long").parquet(*entries).agg(F.max("id")).first()[0] if entries else 0

    def change(new: dict) -> None:
        delta.added(staged)(new)
        new["values"]["article_id"] = max(largest or 0, new["values"]["article_id"])

    return commit(spark, tables, {}, batch if batch[1] >= 0 else None, change=change)


def persist_results(spark: SparkSession, streams: str, tables: str, quarantine: str, checkpoint: str, available_now: bool = False, start: str = "latest", most: int | None = RESULTS_A_BATCH) -> StreamingQuery:
    """Result streams into the tables, one commit for each batch; units of many deltas are made one base now and then."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            persist_batch(spark, df, tables, quarantine, (checkpoint, number))
            for name, layout in delta.LAYOUTS.items():
                delta.compact(spark, tables, name, 64 if layout.grows_only else 16)

    return run_batches(read_results(spark, streams, group_of(checkpoint), most, start), batch, checkpoint, available_now)
