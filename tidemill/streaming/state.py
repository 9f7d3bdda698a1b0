"""The persist flow with its keys in the state store instead of the tables.

State per feed: the jobs whose result has been seen, and the number of errors. Only the first result of each (job, feed) leaves the
state, with the feed's errors up to it, so the commit looks nothing up in job_results, and needs no sum for errors. The
state starts from the tables when a checkpoint is new, and is restored with the checkpoint; a batch that was committed is
skipped as in flows. A job's row must be in the tables before its results are read: results of unknown jobs are dropped as
in flows, but count as seen here. Refused messages pass through to quarantine. The state keeps each (job, feed) for good.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators import delta
from tidemill.sources import payloads
from tidemill.sources.messages import RESULTS_A_BATCH, read_results, split_results
from tidemill.streaming import flows

OUT = "payload string, stream_name string, seq struct<segment:long,file:int,line:long>, error_nbr long"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FeedState(StatefulProcessor):
    """Keyed by feed; rows with a job_id are results, rows without are refused messages."""

    @staticmethod
    def place(r: Row) -> tuple[int, int, int]:
        return r.seq["segment"], r.seq["file"], r.seq["line"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "job_id string", "is_error boolean")
        self.errors = handle.getValueState("errors", "n long")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        if initialState.job_id is not None:
            self.seen.updateValue((initialState.job_id,), (False,))
        if initialState.errors is not None:
            self.errors.update((initialState.errors,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first: dict[str, Row] = {}
        for r in rows:
            if r.job_id is None:
                yield Row(payload=r.payload, stream_name=r.stream_name, seq=r.seq, error_nbr=None)
            elif r.job_id not in first or self.place(r) < self.place(first[r.job_id]):
                first[r.job_id] = r
        found = self.errors.get()
        n = found[0] if found else 0
        for job, r in sorted(first.items(), key=lambda x: self.place(x[1])):
            if not self.seen.containsKey((job,)):
                self.seen.updateValue((job,), (r.is_error,))
                n += r.is_error
                yield Row(payload=r.payload, stream_name=r.stream_name, seq=r.seq, error_nbr=n)
        if first:
            self.errors.update((n,))


def first_results(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Stream of messages (payload, stream_name, seq) without results that are not the first of their (job, feed); seen: what is known
    before (feed_id, job_id, errors, either of these may be NULL)."""
    opened = messages.withColumn("_v", payloads.parse(F.col("payload"))).withColumn("o", payloads.opened_result(F.col("_v")))
    checked = opened.withColumn("_ok", F.size(payloads.result_violations(F.col("o"))) == 0)
    # refused messages are spread, and meet no feed's key
    aside = -1 - F.pmod(F.xxhash64("payload"), F.lit(1024))
    rows = checked.select(
        F.when(F.col("_ok"), payloads.whole_number(F.col("o.feed_id"))).otherwise(aside).alias("feed_id"), F.when(F.col("_ok"), F.col("o.job_id.text")).alias("job_id"),
        F.coalesce(F.col("o.status.text") == "error", F.lit(False)).alias("is_error"), "seq", "stream_name", "payload",
    )
    return rows.groupBy("feed_id").transformWithState(FeedState(), OUT, "Append", "None", initialState=seen.groupBy("feed_id"))


def persist_results(spark: SparkSession, streams: str, tables: str, quarantine: str, checkpoint: str, available_now: bool = False, start: str = "latest", most: int | None = RESULTS_A_BATCH) -> StreamingQuery:
    """As flows.persist_results."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = delta.read(spark, tables, "job_results").select("feed_id", "job_id", F.lit(None).cast("long").alias("errors"))
    counted = delta.read(spark, tables, "scraping").select("feed_id", F.lit(None).cast("string").alias("job_id"), F.col("error_nbr").cast("long").alias("errors"))

    def batch(df: DataFrame, number: int) -> None:
        if flows.done(spark, tables, (checkpoint, number)):
            return
        kept = flows.keep(df, "first")
        if kept.isEmpty():
            return
        valid, refused = split_results(kept)
        errors = kept.select("stream_name", "seq", "error_nbr").filter("error_nbr is not null")
        flows.persist_checked(spark, valid.join(errors, ["stream_name", "seq"]), refused, tables, quarantine, (checkpoint, number), seen=True)

    stream = first_results(read_results(spark, streams, flows.group_of(checkpoint), most, start), known.unionByName(counted))
    return flows.run_batches(stream, batch, checkpoint, available_now)
