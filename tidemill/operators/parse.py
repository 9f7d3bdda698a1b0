"""Feed bodies (RSS, Atom, RDF) to entries, and the choice of an entry's image, as column expressions over nodes in
document order (xml_nodes).

The nodes of an entry are gathered in one array, sorted by place: its children have parent = entry, all inside it count
for images. Under other roots than rss and feed, items and entries count at any depth, one inside another as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.dates import first_date
from tidemill.functions.text import clean, dimension, html_attribute, image_tags, plain_references, query_dimension, srcset, strip, strip_html
from tidemill.operators.xml_nodes import node_table

_DATES = ["pubdate", "published", "updated", "date"]
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "attributePrefix": "_", "valueTag": "_VALUE"}

CANDIDATES = "array<struct<url:string,width:bigint,height:bigint>>"


def first_text(texts: Column) -> Column:
    """The first of the texts that is not blank, stripped."""
    return F.get(F.filter(F.transform(texts, strip), lambda x: x != ""), F.lit(0))


def root_name(body: Column) -> Column:
    """Local name of the root element, lower case; blank if there is none."""
    return F.lower(F.regexp_extract(body, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1))


def entry_url(links: Column) -> Column:
    """Text of the first link that has one, else the first href that is an alternate, else the first href."""
    href = lambda x: F.nullif(strip(x["attributes"]["href"]), F.lit(""))
    rel = lambda x: F.nullif(strip(x["attributes"]["rel"]), F.lit(""))
    alternate = F.filter(links, lambda x: href(x).isNotNull() & (rel(x).isNull() | (rel(x) == "alternate")))
    return F.coalesce(first_text(F.transform(links, lambda x: x["text"])), F.get(F.transform(alternate, href), F.lit(0)), F.get(F.filter(F.transform(links, href), lambda h: h.isNotNull()), F.lit(0)))


def image_candidates(nodes: Column) -> Column:
    """Candidates of image nodes: the address (src of img, url or else href of others), then those of srcset."""

    def of_node(n: Column) -> Column:
        given = n["attributes"]
        address = F.when(n["tag"] == "img", given["src"]).otherwise(F.coalesce(F.nullif(given["url"], F.lit("")), given["href"]))
        own = F.array(F.struct(F.nullif(strip(plain_references(address)), F.lit("")).alias("url"), dimension(given["width"]).alias("width"), dimension(given["height"]).alias("height")))
        listed = F.transform(srcset(plain_references(given["srcset"])), lambda s: F.struct(s["url"].alias("url"), s["width"].alias("width"), dimension(given["height"]).alias("height")))
        return F.concat(own, listed)

    return F.coalesce(F.flatten(F.transform(nodes, of_node)), F.array().cast(CANDIDATES))


def html_images(text: Column) -> Column:
    """Candidates of the img tags in HTML."""

    def of_tag(t: Column) -> Column:
        own = F.array(F.struct(html_attribute(t, "src").alias("url"), dimension(html_attribute(t, "width")).alias("width"), dimension(html_attribute(t, "height")).alias("height")))
        listed = F.transform(srcset(html_attribute(t, "srcset")), lambda s: F.struct(s["url"].alias("url"), s["width"].alias("width"), dimension(html_attribute(t, "height")).alias("height")))
        return F.concat(own, listed)

    return F.flatten(F.transform(image_tags(text), of_tag))


def best_image(candidates: Column) -> Column:
    """Of candidates with a width the largest (then the highest; ties: the first), else the first. Equal urls are one
    candidate with the larger of their dimensions; dimensions in a url's query count."""
    with_query = F.transform(
        F.filter(candidates, lambda c: c["url"].isNotNull()),
        lambda c: F.struct(c["url"].alias("url"), F.greatest(c["width"], query_dimension(c["url"], ["w", "width"])).alias("width"), F.greatest(c["height"], query_dimension(c["url"], ["h", "height"])).alias("height")),
    )
    urls = F.array_distinct(F.transform(with_query, lambda c: c["url"]))

    def merged(u: Column) -> Column:
        same = F.filter(with_query, lambda c: c["url"] == u)
        return F.struct(F.array_max(F.transform(same, lambda c: c["width"])).alias("width"), F.coalesce(F.array_max(F.transform(same, lambda c: c["height"])), F.lit(0)).alias("height"), u.alias("url"))

    distinct = F.transform(urls, merged)
    start = F.struct(F.lit(None).cast("bigint").alias("width"), F.lit(0).cast("bigint").alias("height"), F.lit(None).cast("string").alias("url"))
    better = lambda best, c: c["width"].isNotNull() & (best["width"].isNull() | (c["width"] > best["width"]) | ((c["width"] == best["width"]) & (c["height"] > best["height"])))
    sized = F.aggregate(distinct, start, lambda best, c: F.when(better(best, c), F.struct(c["width"].alias("width"), c["height"].cast("bigint").alias("height"), c["url"].alias("url"))).otherwise(best))
    return F.coalesce(sized["url"], F.get(urls, F.lit(0)))


def root_namespaces(body: Column) -> tuple[Column, Column]:
    """The namespace of the root element (blank: none), and whether the root declares one for children without prefix."""
    tag = F.regexp_extract(body, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([^>]*)>", 1)
    declared = F.lit(r"xmlns(?::([\w.-]+))?\s*=\s*[\"']([^\"']*)[\"']")
    prefixes, addresses = (F.regexp_extract_all(tag, declared, F.lit(k)) for k in (1, 2))
    own = F.regexp_extract(tag, r"^([\w.-]+):", 1)
    return F.coalesce(F.get(addresses, F.array_position(prefixes, own) - 1), F.lit("")), F.array_contains(prefixes, "")


def validate(body: Column, content_type: Column) -> Column:
    """struct(valid, reason) of a response's body: XML by type or look, well-formed, and a feed by its root's name or
    namespace, or by a channel without namespace right below the root."""
    kind, head = F.lower(F.coalesce(content_type, F.lit(""))), strip(F.coalesce(body, F.lit("")))
    looks = kind.rlike("xml|rss|atom") | head.startswith("<?xml") | head.startswith("<rss") | head.startswith("<feed")
    parsed = F.from_xml(body, "channel array<struct<_VALUE:string>>, _bad string", _OPTIONS | {"ignoreNamespace": "false"})
    formed = (head != "") & parsed["_bad"].isNull()
    namespace, default = root_namespaces(body)
    tag = F.concat(F.lower(namespace), root_name(body))
    atom = namespace == "http://www.w3.org/2005/Atom"
    feed = F.contains(tag, F.lit("rss")) | F.contains(tag, F.lit("feed")) | atom | (parsed["channel"].isNotNull() & ~default)
    reason = F.when(~looks, "Not an XML/RSS feed").when(~formed, "Invalid XML").when(~feed, "XML but not RSS/Atom format")
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def parse_bodies(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses(feed_id, body): entries (feed_id, entry_pos, title, url, summary, author, published_at, image_url), and
    feeds (feed_id, last_modified, error). Entries without title or url are left out."""
    nodes = node_table(responses)
    # what is said of the feed: the root, what is right below it, and right below its first channel
    said = nodes.filter("error is not null or entry = -1").groupBy("feed_id").agg(
        F.max("error").alias("error"), F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("pre", "parent", "tag", "text")))).alias("n"),
    )
    root = F.filter("n", lambda x: x["pre"] == 0)[0]["tag"]
    channel = F.get(F.filter("n", lambda x: (x["parent"] == 0) & (x["tag"] == "channel")), F.lit(0))["pre"]
    below = lambda place, name: first_text(F.transform(F.filter("n", lambda x: (x["parent"] == place) & (x["tag"] == name)), lambda x: x["text"]))
    of_channel = F.when(F.col("root") == "rss", first_date(*(below(F.col("channel"), d) for d in ("lastbuilddate", "pubdate", "updated"))))
    modified = F.coalesce(of_channel, first_date(*(below(F.lit(0), d) for d in ("updated", "lastbuilddate", "pubdate"))))
    heads = said.withColumn("root", F.when(F.col("error").isNull(), root)).withColumn("channel", F.when(F.col("error").isNull(), channel))
    feeds = heads.select("feed_id", F.when(F.col("error").isNull(), modified).alias("last_modified"), "error")
    around = nodes.filter("entry >= 0").groupBy("feed_id", "entry").agg(F.array_sort(F.collect_list(F.struct("pre", "parent", "tag", "text", "attributes", "depth"))).alias("n"))
    own = lambda e: F.filter("n", lambda x: x["pre"] == e)[0]
    at = around.withColumn("own", own(F.col("entry"))).join(heads.select("feed_id", "root", "channel"), "feed_id")
    of_rss = (F.col("own.tag") == "item") & (F.col("own.parent") == F.col("channel"))
    of_atom = (F.col("own.tag") == "entry") & (F.col("own.parent") == 0)
    counted = at.filter(F.coalesce(F.when(F.col("root") == "rss", of_rss).when(F.col("root") == "feed", of_atom).otherwise(True), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("feed_id").orderBy("entry")) - 1  # of one body
    return entries(counted.select("feed_id", place.alias("entry_pos"), "entry", "n")), feeds


def entries(found: DataFrame) -> DataFrame:
    """found(feed_id, entry_pos, entry, n: nodes in order) as entries."""
    children = lambda *names: F.filter("n", lambda x: (x["parent"] == F.col("entry")) & x["tag"].isin(*names))
    texts = lambda *names: F.transform(children(*names), lambda x: x["text"])
    first = lambda *names: first_text(texts(*names))
    author = F.get(children("author"), F.lit(0))
    named = first_text(F.transform(F.filter("n", lambda x: (x["parent"] == author["pre"]) & (x["tag"] == "name")), lambda x: x["text"]))
    nodes = F.filter("n", lambda x: (x["pre"] != F.col("entry")) & x["tag"].isin("img", "thumbnail", "content", "enclosure", "image"))
    images = F.concat(image_candidates(nodes), *(html_images(first(name)) for name in ("encoded", "content", "description", "summary")))
    out = found.select(
        "feed_id", "entry_pos", first("title").alias("title"), entry_url(children("link")).alias("url"), first("summary", "description").alias("s1"), first("encoded").alias("s2"), first("content").alias("s3"),
        named.alias("a1"), author["text"].alias("a2"), first("creator").alias("a3"), first("author").alias("a4"), first_date(*(first(d) for d in _DATES)).alias("published_at"), best_image(images).alias("image_url"),
    ).filter("title is not null and url is not null")
    some = lambda c: F.nullif(strip_html(F.col(c)), F.lit(""))
    return out.select("feed_id", "entry_pos", "title", "url", F.coalesce("s1", some("s2"), some("s3")).alias("summary"), F.coalesce(*(some(c) for c in ("a1", "a2", "a3", "a4"))).alias("author"), "published_at", "image_url")


def normalize(raw: DataFrame, floor: str = "2026-01-01 00:00:00", run: list[str] | None = None) -> DataFrame:
    """Entries with title and url, from the floor on, the first of each url in a feed's run (of those that pass)."""
    kept = raw.withColumn("title", clean(F.col("title"))).withColumn("url", clean(F.col("url"))).filter("title is not null and url is not null").filter(F.col("published_at") >= F.lit(floor).cast("timestamp_ntz"))
    w = Window.partitionBy(*(run or ["job_id", "feed_id"]), "url").orderBy("entry_pos")
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def spoiled_feeds(normalized: DataFrame, most: int = 1000) -> DataFrame:
    """Feeds of a run that one overlong url turns into a parse error as a whole: keys and message."""
    return normalized.groupBy("job_id", "feed_id").agg(F.max(F.length("url")).alias("longest")).filter(F.col("longest") > most).select("job_id", "feed_id", F.lit(f"Feed parse error: url longer than {most} characters").alias("error_message"))
