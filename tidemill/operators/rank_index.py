"""An index of places: which part of a sorted table holds the page at an offset.

(latest, source_id) of articles, newest first (those without a date last, then by id from the highest), lies in parts of consecutive
rows, one folder each; the commit keeps the number of rows and the last row of every part. A page adds up the numbers,
at most `parts` of them, and opens the one part (or two) that it is in. New rows go behind those of the parts between whose last
rows they fall, and only the numbers change, so an index is kept up by what a batch adds. build() again evens the parts out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators.upsert import commit, keep, last_commit

#: Rows sort by this, ascending: days without a date come last.
NEVER = 1 << 62


def _key(latest: Column, source_id: Column) -> tuple[Column, Column]:
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), latest)
    return F.coalesce(-at, F.lit(NEVER)).alias("_a"), (-source_id).alias("_b")


def _write(rows: DataFrame, folder: str, name: str) -> dict[str, list]:
    """Rows with _part as a version: {part: [version, rows, last _a, last _b]}."""
    version = uuid.uuid4().hex
    rows.write.partitionBy("_part").parquet(f"{folder}/{name}/{version}")
    written = rows.sparkSession.read.schema("source_id long, latest timestamp_ntz, _a long, _b long, _part int").parquet(f"{folder}/{name}/{version}")
    found = written.groupBy("_part").agg(F.count("*").alias("n"), F.max(F.struct("_a", "_b")).alias("last")).collect()
    return {str(r["_part"]): [version, r["n"], r["last"]["_a"], r["last"]["_b"]] for r in found}


def build(dates: DataFrame, folder: str, name: str = "ranks", parts: int = 256) -> None:
    """Index of dates (source_id, latest), committed in place of the one that is there."""
    rows = dates.select("source_id", "latest", *_key(F.col("latest"), F.col("source_id"))).repartitionByRange(parts, "_a", "_b").sortWithinPartitions("_a", "_b")
    staged = _write(keep(rows.withColumn("_part", F.spark_partition_id()), "ranks"), folder, name)
    commit(dates.sparkSession, folder, {name: {p: {"last": e[2:], "versions": [e[:2]]} for p, e in staged.items()}})


def add(dates: DataFrame, folder: str, name: str = "ranks") -> None:
    """Put rows (of articles that the index has not) in their parts."""
    now = _parts(last_commit(dates.sparkSession, folder), name)
    if not now:
        return build(dates, folder, name)
    rows = dates.select("source_id", "latest", *_key(F.col("latest"), F.col("source_id")))
    here = F.lit(int(now[-1][0]))  # behind all
    for part, entry in reversed(now[:-1]):
        a, b = entry["last"]
        here = F.when((F.col("_a") < a) | ((F.col("_a") == a) & (F.col("_b") <= b)), F.lit(int(part))).otherwise(here)
    staged = _write(keep(rows.withColumn("_part", here.cast("int")), "ranks"), folder, name)

    def change(new: dict) -> None:
        for part, entry in staged.items():
            table = new["tables"][name][part]
            table["versions"].append(entry[:2])
            table["last"] = max(table["last"], entry[2:])

    commit(dates.sparkSession, folder, {}, change=change)


def _parts(at: dict, name: str) -> list[tuple[str, dict]]:
    return sorted(at["tables"].get(name, {}).items(), key=lambda x: x[1]["last"])


def total(spark: SparkSession, folder: str, name: str = "ranks") -> int:
    """Rows in all, from the commit."""
    return sum(n for _, entry in _parts(last_commit(spark, folder), name) for _, n in entry["versions"])


def page(spark: SparkSession, folder: str, limit: int = 50, offset: int = 0, name: str = "ranks") -> DataFrame:
    """source_id, latest and place (from offset) of one page."""
    paths, before, start = [], 0, None
    for part, entry in _parts(last_commit(spark, folder), name):
        n = sum(x[1] for x in entry["versions"])
        if before < offset + limit and before + n > offset:
            start = before if start is None else start
            paths += [f"{folder}/{name}/{version}/_part={part}" for version, _ in entry["versions"]]
        before += n
    schema = "source_id long, latest timestamp_ntz, _a long, _b long"
    if not paths:
        return spark.createDataFrame([], "source_id long, latest timestamp_ntz, place long")
    rows = spark.read.schema(schema).parquet(*paths)
    first = rows.orderBy("_a", "_b").limit(offset + limit - start)
    place = F.row_number().over(Window.orderBy("_a", "_b")) - 1 + start  # of one or two parts, cut at the page's end
    return first.withColumn("place", place.cast("long")).filter(F.col("place") >= offset).select("source_id", "latest", "place")
