"""Keyed upserts as functions over DataFrames, sequence ids, and staged writes.

Parquet tables take no MERGE: an upsert is the table after it, which is written to a new folder and then committed (or, for
the tables of operators.delta, the rows that it changes). The tables below one folder share its commits: a commit is one
file that names the files of every table, written aside and renamed to the next number. Readers see all tables of a batch or none;
a writer who finds the number taken builds its commit anew on the one that took it.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.sources.log import rename_new

#: What becomes of a column when key and batch meet: rule -> (old, new) -> value.
RULES = {
    "replace": lambda old, new: new,
    "coalesce": lambda old, new: F.coalesce(new, old),
    "greatest": lambda old, new: F.greatest(old, new),
    "add": lambda old, new: old + new,
    "keep": lambda old, new: old,
}


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, str], inserts: dict[str, Column] | None = None) -> DataFrame:
    """table with the batch (one row per key) folded in by the rule of each column; columns without a rule are kept.
    inserts: values of new rows for columns that the batch has not."""
    columns = table.columns
    old = table.select(*keys, F.struct(*[c for c in columns if c not in keys]).alias("_old"))
    new = batch.select(*keys, F.struct(*[c for c in batch.columns if c not in keys]).alias("_new"))
    both = old.join(new, keys, "full_outer")
    here, there = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    values = []
    for c in columns:
        if c in keys:
            values.append(F.col(c))
            continue
        before = F.col(f"_old.{c}")
        given = F.col(f"_new.{c}") if c in batch.columns else (inserts or {}).get(c, F.lit(None)).cast(table.schema[c].dataType)
        rule = RULES[rules.get(c, "keep")]
        values.append(F.when(here & there, rule(before, given) if c in batch.columns else before).when(here, before).otherwise(given).cast(table.schema[c].dataType).alias(c))
    return both.select(*values)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is a temporary one on a local master
    (as in tests), and an error on a cluster, whose executors would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def with_ids(rows: DataFrame, order: list[str], last: DataFrame, name: str = "id", parts: int = 64) -> DataFrame:
    """rows numbered from the largest id in `last` (one row, one column) upwards in the order of the columns (which
    must tell rows apart): range parts are counted, then rows are numbered within their part. No window sees all rows."""
    cut = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    cut = keep(cut, "ids")  # parts are sampled, so they are fixed before they are counted
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # `parts` rows
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    start = last.select(F.coalesce(F.col(last.columns[0]), F.lit(0)).alias("_last"))
    out = cut.withColumn("_k", within).join(F.broadcast(before), "_part").crossJoin(F.broadcast(start))  # one row
    return out.withColumn(name, (F.col("_last") + F.col("_before") + F.col("_k")).cast("long")).drop("_part", "_k", "_before", "_last")


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: what several results are made of is computed once."""
    path = f"{shared_dir(df.sparkSession)}/tidemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_version(df: DataFrame, path: str, partition_by: list[str] | None = None, point: bool = True) -> str:
    """Write df as a new version below path (folder/table), and commit it; readers see the old one until then."""
    version = uuid.uuid4().hex
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{version}")
    if point:
        folder, name = path.rstrip("/").rsplit("/", 1)
        commit(df.sparkSession, folder, {name: version})
    return version


def _commits(spark: SparkSession, folder: str):
    """The file system of the commits below folder, and their paths by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_commits")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, at, sorted((str(f.getPath().getName()), f.getPath()) for f in (fs.listStatus(at) if fs.exists(at) else []))


def last_commit(spark: SparkSession, folder: str) -> dict:
    """number, tables (name: version) and batches (source: last batch) of the last whole commit below folder."""
    fs, _, found = _commits(spark, folder)
    for _, path in reversed(found):
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError:  # its writer died before it had written it all
            continue
        finally:
            stream.close()
    return {"number": 0, "tables": {}, "batches": {}}


def commit(
    spark: SparkSession, folder: str, versions: dict[str, str], batch: tuple[str, int] | None = None, keep: int = 20,
    change: Callable[[dict], None] | None = None,
) -> dict:
    """Make versions of tables the current ones, all at once. batch: source and number of what led to them. change: what else
    becomes of the last commit's content. Commits before the last `keep` are removed; versions are not (readers may hold
    them)."""
    folder = folder.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path
    while True:
        fs, _, found = _commits(spark, folder)
        new = last_commit(spark, folder)
        new["number"] = 1 + max([new["number"], *(int(name) for name, _ in found)])
        new["tables"] |= versions
        new["batches"] |= dict([batch]) if batch else {}
        if change:
            change(new)
        aside = f"{folder}/_writing/{uuid.uuid4().hex}"
        stream = fs.create(path(aside), False)
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        fs.mkdirs(path(f"{folder}/_commits"))
        if rename_new(spark, aside, f"{folder}/_commits/{new['number']:012d}"):
            break
        fs.delete(path(aside), False)
    for _, old in found[:-keep]:
        fs.delete(old, False)
    return new


def read_version(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The committed version of the table at path (folder/table)."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/{last_commit(spark, folder)['tables'][name]}")
