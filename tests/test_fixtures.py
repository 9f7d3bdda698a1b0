"""Literal cases: small inputs with the outcomes that the data model asks for."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.functions import dates, text
from tidemill.operators import catalog, parse, partitions, planning, rank_index, reads, results
from tidemill.operators.upsert import upsert, with_ids
from tidemill.sources import catalog as files


def ts(*a):
    return dt.datetime(*a)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def test_normalized_entries(spark):
    """Against a plain loop over dates on both sides of the floor, shared urls, and missing values in every place."""
    floor, step = ts(2026, 1, 1), dt.timedelta(seconds=1)
    dates = [floor - step, floor, None, floor + 40 * step, floor - dt.timedelta(days=400), floor + dt.timedelta(days=9)]
    rows = [(None if k % 11 == 7 else f" headline {k} ", None if k % 13 == 5 else f"https://papers.test/{k * 5 % 9}", dates[k * k % 6 if k % 4 else k // 4 % 6]) for k in range(60)]
    seen, want = set(), []
    for title, url, date in rows:
        if title and url and date and date >= floor and url not in seen:
            seen.add(url)
            want.append(title.strip())
    df = spark.createDataFrame([("j", 1, i, *r) for i, r in enumerate(rows)], "job_id string, feed_id long, entry_pos int, title string, url string, published_at timestamp_ntz")
    assert [r.title for r in parse.normalize(df).orderBy("entry_pos").collect()] == want and 3 < len(want) < 10
    long = df.filter("entry_pos = 1").select("job_id", "feed_id", "entry_pos", F.lit("t").alias("title"), F.repeat(F.lit("u"), 1001).alias("url"), F.lit(floor).alias("published_at"))
    assert "longer than 1000" in parse.spoiled_feeds(parse.normalize(long)).first().error_message


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><lastBuildDate>Sat, 14 Mar 2026 09:30:00 GMT</lastBuildDate>
<item><title> Harbour notes </title><link>https://papers.test/harbour</link><description>Ships of the week</description><author>Ines Q.</author><pubDate>Sat, 14 Mar 2026 08:20:00 GMT</pubDate>
<enclosure url="https://i/e.jpg?w=90"/><description>second</description></item><item><title>No url</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><updated>2026-02-26T12:00:00+02:00</updated><entry><title>T</title><link rel="self" href="https://s"/><link rel="alternate" href="https://alt"/>
<author><name>Ann &amp;amp; Co</name></author><content type="html">&lt;p&gt;Hello &lt;b&gt;you&lt;/b&gt; .&lt;/p&gt;&lt;img src="https://i/1.png" width="300"&gt;</content><media:thumbnail url="https://i/t.png" width="120"/><published>2026-02-26T10:00:00Z</published></entry></feed>"""


def test_feed_bodies(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, "<rss><channel>"), (4, " "), (5, None)], "feed_id long, body string")
    entries, feeds = parse.parse_bodies(df)
    by = {r.feed_id: r for r in entries.collect()}
    assert sorted(by) == [1, 2]
    assert (by[1].title, by[1].url, by[1].summary, by[1].author, by[1].published_at, by[1].image_url) == ("Harbour notes", "https://papers.test/harbour", "Ships of the week", "Ines Q.", ts(2026, 3, 14, 8, 20), "https://i/e.jpg?w=90")
    assert (by[2].url, by[2].summary, by[2].author, by[2].published_at, by[2].image_url) == ("https://alt", "Hello you.", "Ann & Co", ts(2026, 2, 26, 10), "https://i/1.png")
    state = {r.feed_id: (r.last_modified, r.error) for r in feeds.collect()}
    assert state == {1: (ts(2026, 3, 14, 9, 30), None), 2: (ts(2026, 2, 26, 10), None), 3: (None, "invalid XML"), 4: (None, "invalid XML"), 5: (None, "invalid XML")}


def test_validation_of_bodies(spark):
    df = spark.createDataFrame([(1, RSS, None), (2, ATOM, "text/plain"), (3, "<html/>", "application/xml"), (4, "<rss><channel>", None), (5, "hello", "text/html"), (6, "<rss></rss>", None)], "i int, body string, kind string")
    got = {r.i: r.v.reason for r in df.select("i", parse.validate(F.col("body"), F.col("kind")).alias("v")).collect()}
    assert got == {1: None, 2: None, 3: "XML but not RSS/Atom format", 4: "Invalid XML", 5: "Not an XML/RSS feed", 6: None}


def test_planning_order_and_batches(spark):
    """Against a plain loop: in turn one feed of each company that has some left, companies by their first feed."""
    company = {f: (None if f % 6 == 4 else f * f % 7) for f in range(101, 140)}
    queues: dict = {}
    for f, c in company.items():
        queues.setdefault(c or f"alone {f}", []).append(f)  # company 0 is none
    want = []
    while any(queues.values()):
        want += [q.pop(0) for q in queues.values() if q]
    feeds = spark.createDataFrame(list(company.items()), "feed_id long, company_id long").repartition(3)
    out = planning.in_batches(feeds, 4).orderBy("position").collect()
    assert [r.feed_id for r in out] == want and [r.batch for r in out] == [i // 4 for i in range(len(want))]


def test_request_headers(spark):
    df = spark.createDataFrame([(2, "Quay.Papers.TEST", 'W/"q7"', ts(2026, 4, 5, 6, 7, 8)), (1, "Quay.Papers.TEST", None, None)], "level int, host string, etag string, last_update timestamp_ntz")
    strong, weak = [r.h for r in df.select(planning.request_headers(*(F.col(c) for c in df.columns)).alias("h")).collect()]
    assert weak is None and {"Host": "quay.papers.test", "If-None-Match": 'W/"q7"', "If-Modified-Since": "Sun, 05 Apr 2026 06:07:08 GMT"}.items() <= strong.items() and {"Origin", "Referer", "User-Agent"} <= strong.keys()


def test_response_classification(spark):
    r = [(1, 200, {"etag": "x"}, None), (2, 304, {"ETag": '"e"'}, None), (3, 200, {}, None), (4, 200, {"Last-Modified": "Sun, 05 Apr 2026 06:07:08 GMT"}, None), (5, 0, {}, "timeout")]
    df = results.response_columns(spark.createDataFrame([(a, b, c, "", d) for a, b, c, d in r], schemas.RESPONSE)).withColumn("parsed_last_modified", F.lit("2026-01-01").cast("timestamp_ntz")).withColumn("parse_error", F.lit(None).cast("string"))
    state = spark.createDataFrame([(1, 0, None, None), (4, 1, None, ts(2026, 4, 5, 6, 7, 8))], "feed_id long, fetchprotection int, etag string, last_update timestamp_ntz")
    got = {x.feed_id: (x.status, x.error_message, x.new_last_update) for x in results.classify(df, state).collect()}
    assert got == {1: ("error", "Blocked by fetch protection", None), 2: ("not_modified", None, None), 3: ("success", None, ts(2026, 1, 1)), 4: ("not_modified", None, ts(2026, 4, 5, 6, 7, 8)), 5: ("error", "timeout", None)}


MESSAGE = "seq long, job_id string, feed_id long, stream_name string, status string, error_message string, new_etag string, new_last_update timestamp_ntz, fetchprotection int, processed_at timestamp_ntz, sources array<struct<title:string,url:string,summary:string,author:string,published_at:timestamp_ntz,image_url:string>>"


def state(spark):
    empty = lambda s: spark.createDataFrame([], s)
    jobs = spark.createDataFrame([("j", 2), ("k", 3)], "job_id string, feed_count int")
    return {"jobs": jobs, "job_results": empty("job_id string, feed_id long, status string, queue_kind string, error_message string"), "scraping": empty(schemas.SCRAPING), "articles": empty(schemas.ARTICLE), "links": empty(schemas.LINK)}


def messages(spark):
    s = lambda t, u, d=None, summary=None: (t, u, summary, None, d, None)
    ok, bad = schemas.STREAM_INGEST, schemas.STREAM_ERROR
    rows = [
        (1, "j", 1, ok, "success", None, "e1", ts(2026, 1, 1), 2, None, [s("a", "u1", ts(2026, 3, 1), "first"), s("n", "u2")]), (2, "j", 1, ok, "success", None, "again", None, 2, None, [s("x", "u9")]),
        (3, "j", 2, bad, "error", "boom", None, None, 1, None, []), (4, "k", 1, ok, "success", None, None, None, 1, None, [s("a2", "u1", ts(2026, 3, 1))]), (5, "gone", 1, ok, "success", None, None, None, 1, None, []),
    ]
    return spark.createDataFrame(rows, MESSAGE)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def seen(out):
    return [rows(out["jobs"], "job_id", "status", "feeds_processed", "feeds_error"), rows(out["scraping"], "feed_id", "etag", "error_nbr", "error_msg", "fetchprotection"), rows(out["articles"], "title", "url", "summary", "published_at"), len(rows(out["links"], "source_id", "feed_id"))]


def test_persisted_results_and_replays(spark):
    m = messages(spark)
    once = results.persist(m, state(spark))
    want = [[("j", "completed_with_errors", 2, 1), ("k", "processing", 1, 0)], [(1, "e1", 0, None, 1), (2, None, 1, "boom", 1)], [("a2", "u1", "first", ts(2026, 3, 1)), ("n", "u2", None, ts(1970, 1, 1))], 2]
    assert seen(once) == want
    base = {k: once[k].select(v.columns) for k, v in state(spark).items()}
    assert seen(results.persist(m, base)) == want
    half = results.persist(m.filter("seq <= 2"), state(spark))
    rest = results.persist(m.filter("seq > 2"), {k: half[k].select(v.columns) for k, v in state(spark).items()})
    assert seen(rest) == want
    assert seen(results.persist(m.repartition(5, "seq"), state(spark))) == want


def test_upsert_rules_and_ids(spark):
    t = spark.createDataFrame([(1, "a", "x", 5), (2, "b", None, 5)], "id long, key string, note string, n int")
    b = spark.createDataFrame([("b", "new", 3), ("c", None, 9), ("a", None, 1)], "key string, note string, n int")
    out = upsert(t, b, ["key"], {"note": "coalesce", "n": "greatest"}, {"id": F.lit(7)})
    assert rows(out, "id", "key", "note", "n") == [(1, "a", "x", 5), (2, "b", "new", 5), (7, "c", None, 9)]
    ids = with_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"], t.agg(F.max("id")), parts=5).orderBy("k").collect()
    assert [r.id for r in ids] == list(range(3, 1003))


def test_catalog_files(spark, tmp_path):
    d = tmp_path / "c"
    d.mkdir()
    feeds = [{"url": " https://f/1 ", "title": "  News \n x", "tags": [" Big News", "big  news", ""], "fetchprotection": 1, "extra": 1}, {"url": "https://f/2", "fetchprotection": 2}]
    (d / "My_Paper.json").write_text(json.dumps({"host": "WWW.Paper.com:80/x", "img": None, "country": "FR ", "language": "fr", "fetchprotection": 2, "feeds": feeds, "other": {}}))
    good, bad = files.read_catalog(spark, str(d))
    assert bad.count() == 0 and files.checked(good, bad).count() == 1
    c = catalog.catalog_companies(good).first()
    assert (c.name, c.host, c.icon_url, c.country, c.fetchprotection) == ("My Paper", "www.paper.com", None, "fr", 2)
    assert rows(catalog.catalog_feeds(good), "url", "section", "enabled", "fetchprotection") == [("https://f/1", "News x", True, 1), ("https://f/2", None, True, 2)]
    empty = lambda s: spark.createDataFrame([], s)
    tables = {"companies": empty(schemas.COMPANY), "feeds": empty(schemas.FEED), "scraping": empty(schemas.SCRAPING), "tags": empty(schemas.TAG), "feed_tags": empty(schemas.FEED_TAG)}
    after = catalog.sync(good, empty("company string"), tables)
    assert rows(after["feeds"], "id", "url", "company_id") == [(1, "https://f/1", 1), (2, "https://f/2", 1)] and rows(after["tags"], "name") == [("big-news",)] and rows(after["feed_tags"], "feed_id", "tag_id") == [(1, 1)]
    none = catalog.sync(good.limit(0), spark.createDataFrame([("My Paper",)], "company string"), after)
    assert none["feeds"].count() == 0 and none["scraping"].count() == 0 and none["companies"].count() == 1
    first = files.manifest(spark, str(d))
    assert rows(first, "path") == [("My_Paper.json",)] and rows(files.manifest_diff(None, first), "change") == [("added",)] and files.action(first, files.manifest_diff(first, first)) == "up_to_date"
    (d / "Bad.json").write_text("[1")
    with pytest.raises(ValueError, match="Bad.json"):
        files.checked(*files.read_catalog(spark, str(d)))


def test_scalar_functions(spark):
    assert one(spark, text.host, "User@Example.COM:8080/x") == "example.com" and one(spark, text.host, "  ") is None and one(spark, text.host, "https://A.b/c") == "a.b"
    assert one(spark, text.clean, " \t\n") is None and one(spark, text.code2, " FRance") == "fr" and one(spark, text.company_name, "/x/Le_Monde__fr.json") == "Le Monde fr"
    assert one(spark, text.strip_html, "<p>Fish &amp; chips &eacute; ,</p> <b>now</b> !") == "Fish & chips é, now!"
    assert one(spark, text.dimension, "w120px") == 120 and one(spark, text.dimension, "0") is None
    assert [(x.url, x.width) for x in one(spark, text.srcset, "a.jpg 100w, b.jpg 2x,c.jpg")] == [("a.jpg", 100), ("b.jpg", None), ("c.jpg", None)]
    assert one(spark, dates.parse_date, "Thu, 26 Feb 2026 12:00:00 +0200") == ts(2026, 2, 26, 10) and one(spark, dates.parse_date, "2026-02-26 12:00") == ts(2026, 2, 26, 12) and one(spark, dates.parse_date, "soon") is None
    assert one(spark, lambda c: dates.display_date(c.cast("timestamp_ntz"), "full"), None) == "n/a" and one(spark, text.trust_percent, 1.7, "double") == 100
    assert one(spark, text.file_extension, " JSON") == ".json" and one(spark, results.queue_kind, "unknown") == "error"


def test_weeks(spark, tmp_path):
    df = spark.createDataFrame([(1, ts(2026, 2, 18)), (2, ts(2026, 2, 24)), (3, None), (4, ts(1960, 1, 1))], "id long, published_at timestamp_ntz")
    assert rows(partitions.week_starts(df), "week_start") == [(ts(2026, 2, 16),), (ts(2026, 2, 23),)]
    partitions.write_weeks(df, str(tmp_path / "t"))
    for _ in range(2):  # rows of the week stay, and conflicts are ignored
        partitions.write_weeks(df.filter("id = 1").withColumn("id", F.lit(9).cast("long")), str(tmp_path / "t"))
        partitions.write_weeks(df, str(tmp_path / "t"))
        assert sorted((r.id, r.published_at) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, ts(2026, 2, 18)), (2, ts(2026, 2, 24)), (3, ts(1970, 1, 1)), (4, ts(1960, 1, 1)), (9, ts(2026, 2, 18))]


def test_validation_by_namespace_and_direct_channel(spark):
    bodies = [
        ("<?xml version='1.0'?><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/'><channel>x</channel></rdf:RDF>", False),
        ("<entry xmlns='http://www.w3.org/2005/Atom'><title>t</title></entry>", True), ("<a:entry xmlns:a='http://www.w3.org/2005/Atom'/>", True), ("<entry><title>t</title></entry>", False),
        ("<top><channel/></top>", True), ("<top><inner><channel>x</channel></inner></top>", False), ("<top xmlns='urn:x'><channel>x</channel></top>", False), ("<top xmlns='urn:my-rss'/>", True), ("<p:feed xmlns:p='urn:x'/>", True),
    ]
    got = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "i long, b string").select("i", parse.validate(F.col("b"), F.lit("text/xml")).alias("v")).orderBy("i").collect()
    assert [r.v.valid for r in got] == [want for _, want in bodies]


def test_pages_reject_bad_limits(spark, small):
    from tidemill.plans.testbed import tables

    with pytest.raises(ValueError):
        reads.article_page(*tables(spark, small, "article", "link", "feed", "company"), limit=101)


def test_order_and_nested_markup(spark):
    """The first of several children counts whatever its name, text inside markup is text, and an item in an item is both."""
    one = "<rss><channel><item><description> </description><summary>late</summary><description>later</description><title>Sea <i>and <b>sky</b></i>!</title><link> </link><link href='https://o.test/2' rel='via'/><link href='https://o.test/1'/>"
    one += "<author>Cy <x>Vale</x></author><creator>no</creator><div><content href='https://o.test/c.png'/></div><img src='https://o.test/i.png'/><thumbnail url='' href='https://o.test/t.png'/><date>2026-05-04</date><updated>soon</updated></item></channel><updated>2026-05-05T00:00:00Z</updated></rss>"
    two = "<list><item><item><title>In</title><link>https://o.test/in</link><image url='https://o.test/in.png'/></item><title>Out</title><link>https://o.test/out</link></item></list>"
    three = "<feed><item><title>no</title><link>https://o.test/no</link></item><div><entry><title>deep</title><link>https://o.test/deep</link></entry></div><entry><title>yes</title><link>https://o.test/yes</link><author><name> </name>Ed &lt;b&gt;T&lt;/b&gt;</author><encoded>&lt;p&gt;&lt;/p&gt;</encoded><content>c</content></entry></feed>"
    found, feeds = parse.parse_bodies(spark.createDataFrame([(1, one), (2, two), (3, three), (4, "<!DOCTYPE a [<!ENTITY e 'v'>]><rss><channel><item><title>&e;</title><link>l</link></item></channel></rss>")], "feed_id long, body string"))
    got = [(r.feed_id, r.entry_pos, r.title, r.url, r.summary, r.author, r.image_url) for r in found.orderBy("feed_id", "entry_pos").collect()]
    assert got == [
        (1, 0, "Sea and sky!", "https://o.test/1", "late", "Cy Vale", "https://o.test/c.png"), (2, 0, "Out", "https://o.test/out", None, None, "https://o.test/in.png"),
        (2, 1, "In", "https://o.test/in", None, None, "https://o.test/in.png"), (3, 0, "yes", "https://o.test/yes", "c", "Ed T", None), (4, 0, "v", "l", None, None, None),
    ]
    assert {r.feed_id: r.last_modified for r in feeds.collect()} == {1: ts(2026, 5, 5), 2: None, 3: None, 4: None}
    assert found.filter("feed_id = 1").first().published_at == ts(2026, 5, 4)


def test_items_at_any_depth(spark):
    """Under a root that is neither rss nor feed, nested items and entries come in the order of the body."""
    item = lambda tag, n: f"<{tag}><title>T{n}</title><link>https://deep.test/{n}</link></{tag}>"
    body = "<opml xmlns:r='urn:r'><head/><body><outline>" + item("entry", 1) + "<!-- " + item("item", 9) + " --></outline><deeper><deepest>" + item("r:item", 2).replace("</title>", "</title><r:thumbnail url='https://deep.test/2.png'/>") + "<item/></deepest></deeper><items><x/></items></body>" + item("item", 3) + "</opml>"
    found, feeds = parse.parse_bodies(spark.createDataFrame([(1, body), (2, "<opml><body/></opml>")], "feed_id long, body string"))
    assert [(r.title, r.url, r.image_url) for r in found.orderBy("entry_pos").collect()] == [(f"T{n}", f"https://deep.test/{n}", "https://deep.test/2.png" if n == 2 else None) for n in (1, 2, 3)]
    assert [r.error for r in feeds.collect()] == [None, None]


def test_failed_publish_marks_jobs(spark):
    jobs = spark.createDataFrame([("a", True, None, None, 2, "queued", None), ("b", True, None, None, 0, "completed", None)], schemas.JOB)
    batches = spark.createDataFrame([], "job_id string, requested_at timestamp_ntz, ingest boolean, requested_by string, batch long, position long, feed_id long, feed_url string, company_id long, host_header string, fetchprotection int, etag string, last_update timestamp_ntz, last_db_article_published_at timestamp_ntz")

    def broken(messages):
        raise OSError("no sink")

    status = lambda df: {r.job_id: r.status for r in df.collect()}
    assert status(planning.publish(jobs, batches, broken)) == {"a": "failed", "b": "completed"}
    assert status(planning.publish(jobs, batches, lambda m: m.collect())) == {"a": "queued", "b": "completed"}


def test_rules_of_requests(spark):
    """What the model accepts and refuses: defaults, missing and null fields, kinds of values, times with and without zone."""
    from tidemill.sources.messages import split_requests, split_results

    feed = {"feed_id": 3, "feed_url": "https://f"}
    whole = {"job_id": "j", "requested_at": "2026-03-01T02:00:00+02:00", "ingest": True, "requested_by": "me", "feeds": [feed]}
    less = lambda name: {k: v for k, v in whole.items() if k != name}
    cases = [
        (whole, []), (whole | {"feeds": []}, []), (less("feeds"), []), (whole | {"feeds": None}, ["feeds"]), (whole | {"feeds": {}}, ["feeds"]), (whole | {"feeds": [1]}, ["feeds.item"]),
        (less("requested_by"), ["requested_by"]), (less("ingest"), ["ingest"]), (less("requested_at"), ["requested_at"]), (whole | {"requested_at": "soon"}, ["requested_at"]), (whole | {"requested_at": 1772323200}, []),
        (whole | {"feeds": [feed | {"company_id": 0}]}, ["feeds.company_id"]), (whole | {"feeds": [feed | {"company_id": None, "host_header": None, "etag": None, "last_update": None}]}, []), (whole | {"feeds": [feed | {"fetchprotection": None}]}, ["feeds.fetchprotection"]),
        (whole | {"feeds": [feed, feed | {"feed_id": "4"}]}, []), (whole | {"feeds": [feed | {"feed_id": 4.5}]}, ["feeds.feed_id"]), (whole | {"feeds": [feed | {"feed_url": 5}]}, ["feeds.feed_url"]), (whole | {"ingest": "yes", "other": [1]}, []),
        ([whole], ["json"]), (None, ["json"]), (whole | {"requested_at": "2026-03-01"}, []), (whole | {"job_id": "j" * 37}, ["job_id"]), (whole | {"feeds": [feed | {"etag": "e" * 256, "last_update": "x"}]}, ["feeds.etag", "feeds.last_update"]),
    ]
    for k, (c, want) in enumerate(cases):
        if isinstance(c, dict) and not want:
            c["job_id"] = f"k{k}"
            cases[k] = (dict(c), want)
    df = spark.createDataFrame([(None if c is None else json.dumps(c),) for c, _ in cases], "payload string")
    valid, refused = split_requests(df)
    told = {r.payload: r.violations for r in refused.collect()}
    assert told == {None if c is None else json.dumps(c): v for c, v in cases if v}
    rows = {(r.job_id, r.feed_id): r for r in valid.collect()}
    assert len(rows) == sum(len(c.get("feeds", [])) for c, v in cases if not v)
    assert {str(r.requested_at) for r in rows.values()} == {"2026-03-01 00:00:00"} and {r.fetchprotection for r in rows.values()} == {1} and {r.ingest for r in rows.values()} == {True}
    done = {"job_id": "j", "ingest": False, "feed_id": 1, "feed_url": "u", "status": "success", "fetchprotection": 1, "sources": [{"title": "t", "url": "u"}]}
    entries = [[{"title": "", "url": "u"}], [{"title": "t"}], [{"title": "t", "url": "u" * 2000}], [{"title": "t", "url": "u", "published_at": "x"}], "none", [{"title": "t", "url": "u", "author": 5}]]
    results = [done, {k: v for k, v in done.items() if k != "fetchprotection"}, *(done | {"sources": e} for e in entries)]
    df = spark.createDataFrame([(json.dumps(r), k, "s") for k, r in enumerate(results)], "payload string, seq long, stream_name string")
    valid, refused = split_results(df)
    assert [r.seq for r in valid.collect()] == [0]
    assert {r.seq: r.violations for r in refused.collect()} == {1: ["fetchprotection"], 2: ["sources.title"], 3: ["sources.url"], 4: ["sources.url"], 5: ["sources.published_at"], 6: ["sources"], 7: ["sources.author"]}


def test_pacing_over_batches(spark):
    """Against a limiter that is asked in a loop, over three batches; a company's parts are smaller than its requests."""
    from collections import defaultdict, deque

    base, state, sent = ts(2026, 3, 1), spark.createDataFrame([], planning.FREE), defaultdict(deque)
    for batch in range(3):
        rows = [(None if k % 9 == 0 else 1 + (k % 5 == 1), 100 * batch + k, base + dt.timedelta(seconds=3 * batch, milliseconds=130 * (k * k % 11))) for k in range(60 if batch else 3)]
        want = {}
        for company, feed, at in sorted(rows, key=lambda r: (r[2], r[1])):
            last = sent[company or f"feed {feed}"]
            want[feed] = max(at, last[0] + dt.timedelta(seconds=1)) if len(last) == 4 else at
            last.append(want[feed])
            if len(last) > 4:
                last.popleft()
        got, state = planning.send_times(spark.createDataFrame(rows, "company_id long, feed_id long, arrived timestamp_ntz"), state, part=7)
        assert {r.feed_id: r.sent_at for r in got.collect()} == want
    assert {r.company_key: len(r.free) for r in state.collect() if r.company_key.startswith("company")} == {"company:1": 4, "company:2": 4}


def test_deep_page_opens_one_part(spark, tmp_path):
    """Page 2,000 of 120,000 rows, with rows added later, against the sort; files of one part are read."""
    folder = str(tmp_path / "index")
    dates = spark.range(120_000).select(F.col("id").alias("source_id"), F.when(F.col("id") % 50 != 0, F.timestamp_add("HOUR", (F.col("id") * 7919 % 9973).cast("int"), F.lit("2026-01-01").cast("timestamp_ntz"))).alias("latest"))
    late = (F.col("source_id") % 11 == 0) | (F.col("source_id") > 119_990)
    rank_index.build(dates.filter(~late), folder, parts=64)
    rank_index.add(dates.filter(late), folder)
    assert rank_index.total(spark, folder) == 120_000
    for limit, offset in ((50, 100_000), (100, 0), (7, 119_996), (50, 120_000)):
        got = rank_index.page(spark, folder, limit, offset)
        want = dates.orderBy(F.desc_nulls_last("latest"), F.desc("source_id")).offset(offset).limit(limit)
        assert [(r.source_id, r.latest, r.place) for r in got.orderBy("place").collect()] == [(r.source_id, r.latest, offset + k) for k, r in enumerate(want.collect())]
        assert len({f.split("_part=")[1].split("/")[0] for f in got.inputFiles()}) <= 1


def test_toggles_lookups_and_orders(spark):
    feeds = spark.createDataFrame([(i, f"https://f/{9 - i}", f"s{i % 3}", i % 2 == 0, i % 4 / 4, 1) for i in range(1, 8)], schemas.FEED)
    companies = spark.createDataFrame([(1, "c", None, None, None, None, 1, True)], schemas.COMPANY)
    wanted = spark.createDataFrame([(1, True), (2, True), (4, False), (99, True)], "feed_id long, enabled boolean")
    after = catalog.apply_toggles(feeds, catalog.toggle_feeds(wanted, feeds, companies), "feed_id")
    assert {r.id for r in after.filter("enabled").collect()} == {1, 2, 6} and after.columns == feeds.columns and after.count() == 7
    assert reads.by_key(feeds, "id", 3).first().url == "https://f/6" and reads.by_key(feeds, "id", 77).count() == 0
    rows = [(r.id, r.trust_score, r.url) for r in feeds.collect()]
    for sort, key in (("trust_desc", lambda r: (-r[1], r[0])), ("trust_asc", lambda r: (r[1], r[0])), ("url_asc", lambda r: r[2]), ("url_desc", lambda r: [-ord(c) for c in r[2]])):
        assert [r.id for r in reads.search_feeds(feeds, sort=sort).collect()] == [r[0] for r in sorted(rows, key=key)]
    old = feeds.withColumn("fetchprotection", F.col("id").cast("int") - 3).withColumn("etag", F.lit("e"))
    plain, state = partitions.split_scraping(old)
    assert plain.columns == feeds.columns and {r.feed_id: (r.fetchprotection, r.etag) for r in state.collect()} == {i: (min(2, max(0, i - 3)), "e") for i in range(1, 8)}
    split = one(spark, lambda c: dates.display_date(c, "split"), ts(2026, 2, 3, 4, 5), "timestamp_ntz")
    assert (split.date, split.time) == ("03/02/2026", "04:05")


def test_colocated_join_has_no_shuffle(spark, small, tmp_path):
    """Links and articles join and are grouped without an exchange, also in a session that only registers them, and a span prunes both."""
    from tidemill.operators import colocated
    from tidemill.plans.testbed import tables

    article, link, feed = tables(spark, small, "article", "link", "feed")
    want = {(r.source_id, r.latest) for r in reads.latest_dates(article, link, feed).collect()}
    colocated.write(article.select([c.strip().split()[0] for c in schemas.ARTICLE.split(",")]), link, f"file://{tmp_path}", buckets=4)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for again in (False, True):
            if again:
                colocated.register(spark, f"file://{tmp_path}", "other", buckets=4)
            df = colocated.latest_dates(spark, "other" if again else "colocated")
            assert {(r.source_id, r.latest) for r in df.collect()} == want
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        span = spark.table("colocated_links").filter("span <> 'none'").first().span
        some = colocated.linked(spark, spans=[span])
        plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
        assert len(re.findall(rf"PartitionFilters: \[.*{span}", plan)) == 2 and "Exchange" not in plan and some.count() > 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for name in ("colocated_articles", "colocated_links", "other_articles", "other_links"):
            spark.sql(f"drop table if exists {name}")


def test_refused_requests_of_equal_payloads_stay_apart(spark):
    from tidemill.sources.messages import split_requests

    m = spark.createDataFrame([(1, "s", "{}"), (2, "s", "{}"), (3, "s", "no")], "seq long, stream_name string, payload string")
    _, refused = split_requests(m)
    assert sorted((r.seq, r.stream_name, r.payload) for r in refused.collect()) == [(1, "s", "{}"), (2, "s", "{}"), (3, "s", "no")]


def test_bodies_come_in_small_batches(spark):
    """Whatever the session has set: long bodies do not fill a Python worker, and no node is lost where a batch of nodes is cut."""
    from tidemill.operators.xml_nodes import node_table

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(1 << 30))
    try:
        items = "".join(f"<item><title>{i}</title><description>{'x' * 3000}</description></item>" for i in range(900))
        nodes = node_table(spark.createDataFrame([(1, f"<rss><channel>{items}</channel></rss>")], "feed_id int, body string"))
        assert int(spark.conf.get(key)) <= 4 << 20
        assert nodes.filter("entry >= 0").count() == 2700 and nodes.filter("tag = 'description' and length(text) = 3000").count() == 900
    finally:
        spark.conf.unset(key)
