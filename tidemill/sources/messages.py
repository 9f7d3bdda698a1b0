"""Request and result streams as message logs (sources.log): one JSON payload per message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.results import route
from tidemill.operators.upsert import keep
from tidemill.schemas import STREAM_CHECK, STREAM_ERROR, STREAM_INGEST, STREAM_REQUEST
from tidemill.sources import payloads
from tidemill.sources.log import append, read_log

#: In the order in which the streams of one segment arrive.
RESULT_STREAMS = [STREAM_CHECK, STREAM_INGEST, STREAM_ERROR]
#: Messages a batch (fixed values of the two consumers).
REQUESTS_A_BATCH, RESULTS_A_BATCH = 20, 10
_FIELDS = ["job_id", "ingest", "feed_id", "feed_url", "status", "error_message", "new_etag", "new_last_update", "fetchprotection", "sources"]


def payload(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("payload")


def read_requests(spark: SparkSession, folder: str, group: str, most: int | None = REQUESTS_A_BATCH, start: str = "latest") -> DataFrame:
    """Stream of requests, undecoded, in batches of at most `most`; a new group starts with what is published after it."""
    return read_log(spark, folder, [STREAM_REQUEST], group, most, start)


def read_results(spark: SparkSession, folder: str, group: str, most: int | None = RESULTS_A_BATCH, start: str = "latest") -> DataFrame:
    """As read_requests, of the three result streams together."""
    return read_log(spark, folder, RESULT_STREAMS, group, most, start)


def _checked(messages: DataFrame, opened: Callable[[Column], Column], violations: Callable[[Column], Column]) -> DataFrame:
    """messages with what is in them (o) and violations, as a table: both halves read it."""
    rows = messages.withColumn("_v", payloads.parse(F.col("payload"))).withColumn("o", opened(F.col("_v"))).drop("_v")
    return keep(rows.withColumn("violations", violations(F.col("o"))), "checked")


def split_requests(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests as one row per feed, and those refused as payload, stream_name and seq (where messages have them) and violations.
    A request that breaks a rule anywhere is refused as a whole; one without feeds is valid and has no row."""
    checked = _checked(messages, payloads.opened_request, payloads.request_violations)
    valid = checked.filter(F.size("violations") == 0).select(*payloads.request_columns(F.col("o")))
    feeds = valid.select("job_id", "requested_at", "ingest", "requested_by", F.explode("feeds").alias("f")).select("job_id", "requested_at", "ingest", "requested_by", "f.*")
    told = [c for c in ("stream_name", "seq") if c in messages.columns]
    return feeds, checked.filter(F.size("violations") > 0).select("payload", *told, "violations")


def split_results(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results as rows of schemas.RESULT with stream_name and seq, and those refused (payload, stream_name, seq, violations)."""
    checked = _checked(messages, payloads.opened_result, payloads.result_violations)
    valid = checked.filter(F.size("violations") == 0).select("stream_name", "seq", *payloads.result_columns(F.col("o")))
    return valid, checked.filter(F.size("violations") > 0).select("payload", "stream_name", "seq", "violations")


def write_results(results: DataFrame, folder: str) -> int | None:
    """Publish results (schemas.RESULT), each to its stream, as one segment."""
    return append(results.select(payload(*_FIELDS), "status", "ingest"), folder, route(F.col("status"), F.col("ingest")))


def write_requests(messages: DataFrame, folder: str) -> int | None:
    return append(messages, folder, STREAM_REQUEST)
