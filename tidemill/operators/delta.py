"""Tables of base and delta files per unit: a batch writes the rows that it changes, and readers merge them.

The rows of a table are dealt to units, hash buckets of a key or spans of weeks; a commit lists, for each unit, the versions that hold its
rows, oldest first: a base, then a delta for each batch that touched it. A delta holds rows as they are after the batch, with
the number of the commit that it was made on; of rows with one key the latest is the row (or, with _gone, none). Rows of
tables that only grow need no merging. Units are folders of a version, so a reader that knows its keys opens
the files of their units only. compact() makes one base of a unit's versions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.operators.upsert import commit, last_commit
from tidemill.schemas import epoch


@dataclass(frozen=True)
class Layout:
    """How a table is stored: its schema, key, and whether rows only come (and never change or go). by: the column of
    the unit; a key to be hashed into `buckets`, or, without buckets, a time to be cut into spans of `weeks` weeks."""

    schema: str
    keys: tuple[str, ...]
    by: str
    buckets: int | None = 64
    weeks: int = 4
    grows_only: bool = False

    def unit(self) -> Column:
        if self.buckets is None:
            days = 7 * self.weeks
            monday = F.lit("1970-01-05").cast("date")
            first = F.date_add(monday, (F.floor(F.date_diff(F.col(self.by), monday) / days) * days).cast("int"))
            return F.when(F.col(self.by) > epoch(), first.cast("string")).otherwise("none")
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("string")

    @property
    def columns(self) -> list[str]:
        return [c.strip().split()[0] for c in self.schema.split(",")]


COUNTS = "job_id string, feeds_processed long, feeds_success long, feeds_not_modified long, feeds_error long"

LAYOUTS = {
    "jobs": Layout(schemas.JOB, ("job_id",), "job_id"),
    "job_counts": Layout(COUNTS, ("job_id",), "job_id"),
    "job_results": Layout(schemas.JOB_RESULT, ("job_id", "feed_id"), "job_id", grows_only=True),
    "scraping": Layout(schemas.SCRAPING, ("feed_id",), "feed_id"),
    # the id tells apart articles of one url and date, which a table may have from before
    "articles": Layout(schemas.ARTICLE, ("url", "published_at", "id"), "published_at", buckets=None),
    "links": Layout(schemas.LINK, ("source_id", "feed_id", "published_at"), "published_at", buckets=None, grows_only=True),
}


def stage(rows: DataFrame, folder: str, name: str, layout: Layout, number: int = 0) -> dict[str, list]:
    """Write rows (with or without _gone) as a version of the table: {unit: [version, bytes]}. number: of the commit that they
    were made on. Units of any size are spread over tasks by ranges of their keys."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    gone = F.col("_gone") if "_gone" in rows.columns else F.lit(False)
    out = rows.select(*layout.columns, gone.alias("_gone"), F.lit(number).cast("long").alias("_seq"), layout.unit().alias("_unit"))
    at = f"{folder.rstrip('/')}/{name}/{version}"
    out.repartitionByRange("_unit", *layout.keys).write.partitionBy("_unit").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    units = [f.getPath() for f in fs.listStatus(path) if str(f.getPath().getName()).startswith("_unit=")]
    return {str(u.getName())[6:]: [version, int(fs.getContentSummary(u).getLength())] for u in units}


def added(staged: dict[str, dict[str, list]]):
    """A change of a commit: staged versions behind those of their units."""

    def change(new: dict) -> None:
        for name, units in staged.items():
            table = new["tables"].setdefault(name, {})
            for unit, entry in units.items():
                table[unit] = [*table.get(unit, []), entry]

    return change


def create(folder: str, tables: dict[str, DataFrame]) -> None:
    """Commit the first content of tables of LAYOUTS, in place of any that is there."""
    staged = {name: stage(df, folder, name, LAYOUTS[name]) for name, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    commit(spark, folder, {name: {u: [e] for u, e in units.items()} for name, units in staged.items()})


def read(spark: SparkSession, folder: str, name: str, keys: DataFrame | None = None, at: dict | None = None, units: list[str] | None = None) -> DataFrame:
    """The rows of a table as of a commit (default: the last one), those whose key columns are among `keys` (any of the
    layout's columns that include the unit's) if given."""
    layout = LAYOUTS[name]
    versions = (at or last_commit(spark, folder))["tables"].get(name, {})
    if keys is not None and units is None:
        units = [r[0] for r in keys.select(layout.unit()).distinct().collect()]  # buckets, or spans of weeks
    chosen = {u: entries for u, entries in versions.items() if units is None or u in units}
    place = lambda u, e: f"{folder.rstrip('/')}/{name}/{e[0]}/_unit={u}"
    one = [place(u, e) for u, entries in chosen.items() for e in entries if layout.grows_only or len(entries) == 1]
    several = [place(u, e) for u, entries in chosen.items() for e in entries if not layout.grows_only and len(entries) > 1]
    wide = f"{layout.schema}, _gone boolean, _seq long"
    none = keys is not None and not chosen
    wanted = lambda df: df if keys is None or none else df.join(keys.select([c for c in keys.columns if c in layout.columns]).distinct(), [c for c in keys.columns if c in layout.columns], "left_semi")
    rows = wanted(spark.read.schema(wide).parquet(*one)) if one else spark.createDataFrame([], wide)
    if several:
        rest = [c for c in layout.columns if c not in layout.keys]
        layered = wanted(spark.read.schema(wide).parquet(*several)).groupBy(*layout.keys).agg(F.max_by(F.struct(*rest, "_gone"), "_seq").alias("_r"))
        rows = rows.select(*layout.columns, "_gone").unionByName(layered.select(*layout.keys, "_r.*"))
    return rows.filter("not _gone").select(layout.columns)


def compact(spark: SparkSession, folder: str, name: str, most: int = 8) -> list[str]:
    """Give each unit of more than `most` versions one base; the units. Versions that a batch adds meanwhile stay behind
    it."""
    layout, last = LAYOUTS[name], last_commit(spark, folder)
    full = {u: entries for u, entries in last["tables"].get(name, {}).items() if len(entries) > most}
    if not full:
        return []
    base = stage(read(spark, folder, name, at=last, units=list(full)), folder, name, layout, last["number"])

    def change(new: dict) -> None:
        for unit, entries in full.items():
            now = new["tables"][name][unit]
            if now[: len(entries)] != entries:
                raise RuntimeError(f"{name} {unit} was compacted by another writer")
            new["tables"][name][unit] = [*([base[unit]] if unit in base else []), *now[len(entries) :]]

    commit(spark, folder, {}, change=change)
    return sorted(full)
