"""The ten tables through an embedded database, and writes that fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.sources import jdbc

KEYS = {"companies": "id", "feeds": "id", "tags": "id", "feed_tags": "feed_id", "scraping": "feed_id", "articles": "id", "links": "source_id", "jobs": None, "job_feeds": "feed_id", "job_results": "feed_id"}
SCHEMAS = dict(zip(KEYS, [schemas.COMPANY, schemas.FEED, schemas.TAG, schemas.FEED_TAG, schemas.SCRAPING, schemas.ARTICLE, schemas.LINK, schemas.JOB, schemas.JOB_FEED, schemas.JOB_RESULT], strict=True))


def value(kind: str, k: int):
    if k % 5 == 4:
        return None
    return {"long": k, "int": k % 3, "string": f"text {k} é", "boolean": k % 2 == 0, "double": k / 4, "timestamp_ntz": dt.datetime(2026, 3, 29, k % 24, 30)}[kind]


def test_ten_tables(spark):
    url = "jdbc:derby:memory:ten;create=true"
    for name, schema in SCHEMAS.items():
        fields = [f.strip().split() for f in schema.split(",")]
        rows = [tuple(value(kind, k + i) if i else value(kind, 5 * k + 1 if kind == "string" else 5 * k) for i, (_, kind) in enumerate(fields)) for k in range(40)]
        df = spark.createDataFrame(rows, schema)
        for _ in range(2):  # made, then put in its place
            jdbc.write_table(df, url, name, parts=3)
        back = jdbc.read_table(spark, url, name, KEYS[name], parts=4)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.dtypes == df.dtypes
        assert back.rdd.getNumPartitions() >= 4 if KEYS[name] else back.rdd.getNumPartitions() == 1


def test_crowded_ranges_are_cut(spark):
    """Nine tenths of the rows lie in a hundredth of the key's range."""
    url = "jdbc:derby:memory:crowd;create=true"
    ids = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id")).when(F.col("id") < 999, F.col("id") * 1000).alias("id"))
    jdbc.write_table(ids, url, "crowd")
    back = jdbc.read_table(spark, url, "crowd", "id", parts=4)
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and back.distinct().count() == 1000 and max(sizes) <= 251
    narrow = spark.range(1000).select((F.col("id") * F.col("id")).alias("id"))
    jdbc.write_table(narrow, url, "narrow")
    sizes = [r["count"] for r in jdbc.read_table(spark, url, "narrow", "id", parts=5).groupBy(F.spark_partition_id()).count().collect()]
    assert 5 <= len(sizes) <= 7 and max(sizes) <= 200
    jdbc.write_table(narrow.limit(0), url, "narrow")
    assert jdbc.read_table(spark, url, "narrow", "id").count() == 0


def test_a_failed_write_leaves_the_table(spark, monkeypatch):
    url = "jdbc:derby:memory:failed;create=true"
    jdbc.write_table(spark.range(3), url, "kept")
    with pytest.raises(Exception):
        jdbc.write_table(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id")), url, "kept")
    monkeypatch.setitem(jdbc.RENAME, "derby", "rename table {0} to no_such_schema.{1}")
    with pytest.raises(Exception):
        jdbc.write_table(spark.range(9), url, "kept")
    assert jdbc.read_table(spark, url, "kept", "id").count() == 3
