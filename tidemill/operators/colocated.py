"""Articles and links stored so that they join where they lie.

Both tables are bucketed on the article's id, with the same number of buckets, and partitioned by spans of weeks. A join on (id,
published_at, span) then needs no shuffle on either side, nor does a grouping by id after it, and a condition on the span of one side
prunes the files of both. Each bucket of a span is one sorted file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.delta import Layout
from tidemill.schemas import ARTICLE, LINK

BUCKETS = 64
KEYS = {"articles": "id", "links": "source_id"}
_SCHEMAS = {"articles": ARTICLE, "links": LINK}


def span_of(published_at: str = "published_at", weeks: int = 4) -> Column:
    """The span of weeks of a date, by its first day; none for the epoch and before."""
    return Layout("", (), published_at, buckets=None, weeks=weeks).unit()


def write(articles: DataFrame, links: DataFrame, folder: str, prefix: str = "colocated", buckets: int = BUCKETS) -> None:
    """Store both below folder, and register them in the session's catalog."""
    for name, df in (("articles", articles), ("links", links)):
        key = KEYS[name]
        # dealt as buckets are, so a bucket is written by one task
        rows = df.withColumn("span", span_of()).repartition(buckets, key).sortWithinPartitions("span", key)
        spark = df.sparkSession
        spark.sql(f"drop table if exists {prefix}_{name}")
        rows.write.mode("overwrite").option("path", f"{folder}/{name}").partitionBy("span").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{prefix}_{name}")


def register(spark: SparkSession, folder: str, prefix: str = "colocated", buckets: int = BUCKETS) -> None:
    """Make tables that another session has stored known to this one."""
    for name, key in KEYS.items():
        spark.sql(f"drop table if exists {prefix}_{name}")
        columns = f"{_SCHEMAS[name]}, span string"
        spark.sql(f"create table {prefix}_{name} ({columns}) using parquet partitioned by (span) clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{folder}/{name}'")
        spark.sql(f"alter table {prefix}_{name} recover partitions")


def linked(spark: SparkSession, prefix: str = "colocated", spans: list[str] | None = None) -> DataFrame:
    """Links with their article, of some spans if given: source_id, feed_id, published_at, span and the article's columns."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # the bucket's key is one of the join's
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")
    a = spark.table(f"{prefix}_articles").withColumnRenamed("id", "source_id")
    l = spark.table(f"{prefix}_links")  # noqa: E741
    if spans is not None:
        l = l.filter(F.col("span").isin(spans))  # noqa: E741
    return l.join(a, ["source_id", "published_at", "span"])


def latest_dates(spark: SparkSession, prefix: str = "colocated", spans: list[str] | None = None) -> DataFrame:
    """source_id, latest: of linked articles."""
    return linked(spark, prefix, spans).groupBy("source_id").agg(F.max("published_at").alias("latest"))
