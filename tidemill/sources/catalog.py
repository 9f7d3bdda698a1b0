"""Catalog files, and what changed between two versions of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import clean, company_name
from tidemill.schemas import CATALOG, number_between, text_between, violations


def read_catalog(spark: SparkSession, folder: str, extension: str = ".json") -> tuple[DataFrame, DataFrame]:
    """One object per file: good files (schemas.CATALOG, path; the name from the file where there is none), and files
    that break a rule or are no JSON object (path, violations). Any of these fails the whole sync: see checked."""
    schema = f"{CATALOG}, _corrupt string"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").json(folder)
    rows = raw.withColumn("path", F.col("_metadata.file_path")).withColumn("company", F.coalesce(clean(F.col("company")), company_name(F.url_decode("path"))))
    rows = rows.withColumn("violations", violations(_rules()))
    return rows.filter(F.size("violations") == 0).drop("violations", "_corrupt"), rows.filter(F.size("violations") > 0).select("path", "violations")


def _rules() -> dict[str, Column]:
    feeds = F.coalesce("feeds", F.array().cast("array<struct<url:string,title:string,tags:array<string>,enabled:boolean,trust_score:double,fetchprotection:int>>"))
    return {
        "json": F.col("_corrupt").isNull(),
        "company": text_between("company", 1, 100),
        "fetchprotection": number_between("fetchprotection", 0, 2, required=False),
        "feeds.url": F.forall(feeds, lambda f: F.coalesce(F.length(f["url"]).between(1, 500), F.lit(False))),
        "feeds.trust_score": F.forall(feeds, lambda f: F.coalesce(f["trust_score"].between(0.0, 1.0), F.lit(True))),
        "feeds.fetchprotection": F.forall(feeds, lambda f: F.coalesce(f["fetchprotection"].between(0, 2), F.lit(True))),
    }


def checked(good: DataFrame, bad: DataFrame) -> DataFrame:
    """good, unless a file broke a rule."""
    first = bad.orderBy("path").first()
    if first is not None:
        raise ValueError(f"{first.path}: {', '.join(first.violations)}")
    return good


def manifest(spark: SparkSession, folder: str, extension: str = ".json") -> DataFrame:
    """path (below the folder) and digest of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(folder)
    return files.select(relative_path(F.col("path"), folder).alias("path"), F.sha2("content", 256).alias("digest"))


def relative_path(path: Column, folder: str) -> Column:
    bare = folder.split("://", 1)[-1].split(":", 1)[-1].strip("/")
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9+.-]+:/*", ""), f"^/*\\Q{bare}\\E/*", "")


def manifest_diff(old: DataFrame | None, new: DataFrame, force: bool = False) -> DataFrame:
    """path, change (added, modified, deleted; all files are added at first or by force), sorted by path."""
    if old is None or force:
        return new.select("path", F.lit("added").alias("change")).orderBy("path")
    both = old.select("path", F.col("digest").alias("before")).join(new.select("path", F.col("digest").alias("after")), "path", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") != F.col("after"), "modified")
    return both.select("path", change.alias("change")).filter("change is not null").orderBy("path")


def action(old: DataFrame | None, diff: DataFrame) -> str:
    """cloned, update or up_to_date."""
    return "cloned" if old is None else "up_to_date" if diff.isEmpty() else "update"
