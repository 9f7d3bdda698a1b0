"""Catalog: publishers and their feeds from files into tables; toggles; removal of what files no longer name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import clamp, clean, code2, collapse, host, protection_or, section, tag_slugs
from tidemill.operators.upsert import upsert, with_ids
from tidemill.schemas import PROTECTION_DEFAULT


def catalog_companies(catalog: DataFrame) -> DataFrame:
    """Company rows of catalog files (schemas.CATALOG and path): the last file by path wins for a name."""
    rows = catalog.select(
        F.nullif(collapse(F.col("company")), F.lit("")).alias("name"), host(F.col("host")).alias("host"), clean(F.col("img")).alias("icon_url"), code2(F.col("country")).alias("country"),
        code2(F.col("language")).alias("language"), clamp(F.coalesce("fetchprotection", F.lit(PROTECTION_DEFAULT))).alias("fetchprotection"), "path",
    ).filter("name is not null")
    return rows.groupBy("name").agg(F.max_by(F.struct("host", "icon_url", "country", "language", "fetchprotection"), "path").alias("c")).select("name", "c.*")


def catalog_feeds(catalog: DataFrame) -> DataFrame:
    """Feed rows of catalog files: url is the key; the last file (then place in it) wins, protection takes the highest."""
    f = catalog.select("path", F.nullif(collapse(F.col("company")), F.lit("")).alias("company"), F.coalesce("fetchprotection", F.lit(PROTECTION_DEFAULT)).alias("level"), F.posexplode("feeds").alias("pos", "f"))
    rows = f.select(
        clean(F.col("f.url")).alias("url"), section(F.col("f.title")).alias("section"), tag_slugs(F.coalesce("f.tags", F.array().cast("array<string>"))).alias("tags"), F.coalesce("f.enabled", F.lit(True)).alias("enabled"),
        F.coalesce("f.trust_score", F.lit(0.5)).alias("trust_score"), protection_or(F.col("f.fetchprotection"), F.col("level")).alias("fetchprotection"), "company", F.struct("path", "pos").alias("at"),
    ).filter("url is not null")
    last = F.max_by(F.struct("section", "tags", "enabled", "trust_score", "company"), "at").alias("f")
    return rows.groupBy("url").agg(last, F.max("fetchprotection").alias("fetchprotection")).select("url", "f.*", "fetchprotection")


def update_companies(companies: DataFrame, rows: DataFrame) -> DataFrame:
    """By name; enabled is never touched, and true for new ones."""
    rules = dict.fromkeys(["host", "icon_url", "country", "language", "fetchprotection"], "replace")
    fresh = rows.select("name").join(companies.select("name"), "name", "left_anti")
    ids = with_ids(fresh, ["name"], companies.agg(F.max("id").alias("id")))
    return upsert(companies, rows.join(ids, "name", "left"), ["name"], rules, {"enabled": F.lit(True)}).select(companies.columns)


def update_feeds(feeds: DataFrame, scraping: DataFrame, rows: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feeds by url with their company, and scrape state, whose protection is never lowered."""
    c = companies.select(F.col("name").alias("company"), F.col("id").alias("company_id"))
    fresh = rows.select("url").join(feeds.select("url"), "url", "left_anti")
    ids = with_ids(fresh, ["url"], feeds.agg(F.max("id").alias("id")))
    batch = rows.join(c, "company", "left").join(ids, "url", "left")
    out = upsert(feeds, batch.select("url", "id", "section", "enabled", "trust_score", "company_id"), ["url"], dict.fromkeys(["section", "enabled", "trust_score", "company_id"], "replace")).select(feeds.columns)
    levels = rows.select("url", "fetchprotection").join(out.select("url", F.col("id").alias("feed_id")), "url").select("feed_id", "fetchprotection")
    return out, upsert(scraping, levels, ["feed_id"], {"fetchprotection": "greatest"}, {"error_nbr": F.lit(0)})


def new_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """Names (distinct) that are no tags yet."""
    return names.select("name").distinct().join(tags.select("name"), "name", "left_anti")


def get_or_create_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """tags with the missing names added, ids in order of name."""
    ids = with_ids(new_tags(names, tags), ["name"], tags.agg(F.max("id").alias("id")))
    return tags.unionByName(ids.select("id", "name"))


def feed_tag_links(rows: DataFrame, feeds: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """feed_tags after the feeds of rows (url, tags) have exactly their tags."""
    touched = rows.select("url", "tags").join(feeds.select("url", F.col("id").alias("feed_id")), "url")
    new = touched.select("feed_id", F.explode("tags").alias("name")).join(tags.select("name", F.col("id").alias("tag_id")), "name").select("feed_id", "tag_id")
    return links.join(touched.select("feed_id"), "feed_id", "left_anti").select("feed_id", "tag_id").unionByName(new.distinct())


def removed_feeds(feeds: DataFrame, expected: DataFrame) -> DataFrame:
    """Feeds of companies in `expected` (company_id, url; url NULL for a file that is gone) that it does not name."""
    own = feeds.join(expected.select("company_id").distinct(), "company_id", "left_semi")
    named = expected.filter("url is not null").select("company_id", "url").distinct()
    return own.join(named, ["company_id", "url"], "left_anti").select(feeds.columns)


def cascade(children: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Tables with a feed_id, without the rows of removed feeds."""
    gone = removed.select(F.col("id").alias("feed_id"))
    return {name: df.join(gone, "feed_id", "left_anti").select(df.columns) for name, df in children.items()}


def toggle_outcome(found: Column, same: Column, allowed: Column) -> Column:
    return F.when(~found, "missing").when(same, "unchanged").when(~allowed, "forbidden").otherwise("updated")


def toggle_feeds(toggles: DataFrame, feeds: DataFrame, companies: DataFrame) -> DataFrame:
    """toggles(feed_id, enabled) with the outcome of each; a feed of a disabled company stays as it is."""
    f = feeds.select(F.col("id").alias("feed_id"), F.col("enabled").alias("now"), "company_id")
    c = companies.select(F.col("id").alias("company_id"), F.col("enabled").alias("company_enabled"))
    t = toggles.join(f, "feed_id", "left").join(c, "company_id", "left")
    out = toggle_outcome(F.col("now").isNotNull(), F.col("now") == F.col("enabled"), F.coalesce("company_enabled", F.lit(True)))
    return t.select("feed_id", "enabled", out.alias("outcome"))


def toggle_companies(toggles: DataFrame, companies: DataFrame) -> DataFrame:
    """toggles(company_id, enabled) with outcomes; feeds are not touched."""
    c = companies.select(F.col("id").alias("company_id"), F.col("enabled").alias("now"))
    out = toggle_outcome(F.col("now").isNotNull(), F.col("now") == F.col("enabled"), F.lit(True))
    return toggles.join(c, "company_id", "left").select("company_id", "enabled", out.alias("outcome"))


def apply_toggles(table: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    changed = outcomes.filter("outcome = 'updated'").select(F.col(key).alias("id"), "enabled")
    return upsert(table, changed, ["id"], {"enabled": "replace"}).select(table.columns)


def sync(catalog: DataFrame, gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after changed catalog files; gone(company): companies whose file was deleted lose all feeds."""
    out = dict(tables)
    out["companies"] = update_companies(tables["companies"], catalog_companies(catalog))
    rows = catalog_feeds(catalog)
    out["feeds"], out["scraping"] = update_feeds(tables["feeds"], tables["scraping"], rows, out["companies"])
    out["tags"] = get_or_create_tags(rows.select(F.explode("tags").alias("name")), tables["tags"])
    out["feed_tags"] = feed_tag_links(rows, out["feeds"], out["tags"], tables["feed_tags"])
    names = out["companies"].select(F.col("name").alias("company"), F.col("id").alias("company_id"))
    named = catalog.select(F.nullif(collapse(F.col("company")), F.lit("")).alias("company"), F.explode_outer("feeds").alias("f")).select("company", clean(F.col("f.url")).alias("url"))
    expected = named.unionByName(gone.select("company", F.lit(None).cast("string").alias("url"))).join(names, "company").select("company_id", "url")
    removed = removed_feeds(out["feeds"], expected)
    out["feeds"] = out["feeds"].join(removed.select("id"), "id", "left_anti").select(tables["feeds"].columns)
    return out | cascade({n: out[n] for n in ("feed_tags", "scraping", "links", "job_feeds", "job_results") if n in out}, removed)
