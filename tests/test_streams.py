"""Both streams from logs to tables, their replay, the order of arrival, and the log as a source."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import RSS
from tidemill import schemas
from tidemill.operators import delta
from tidemill.operators.upsert import last_commit
from tidemill.sources.log import append, read_log
from tidemill.sources.messages import write_requests, write_results
from tidemill.streaming import flows

NAMES = ["jobs", "job_results", "scraping", "articles", "links", "job_counts"]


def empty_tables(spark, feeds=2, jobs=("j1",)):
    out = {name: spark.createDataFrame([], layout.schema) for name, layout in delta.LAYOUTS.items() if name != "job_counts"}
    out["jobs"] = spark.createDataFrame([(j, True, "me", None, feeds, "queued", None) for j in jobs], schemas.JOB)
    out["feeds"] = spark.createDataFrame([(i, f"https://f/{i}", None, True, 0.5, 1) for i in range(1, feeds + 1)], schemas.FEED)
    return out


def rows_of(spark, folder, name):
    return sorted(map(str, delta.read(spark, folder, name).drop("processed_at").collect()))


def result(job, feed, status="success", **more):
    return json.dumps({"job_id": job, "ingest": True, "feed_id": feed, "feed_url": f"https://f/{feed}", "status": status, "fetchprotection": 1, "sources": []} | more)


def test_requests_to_tables(spark, tmp_path):
    at = lambda *p: str(tmp_path.joinpath(*p))
    feeds = [{"feed_id": i, "feed_url": f"https://f/{i}", "company_id": 1, "fetchprotection": 1} for i in (1, 2)]
    request = json.dumps({"job_id": "j1", "requested_at": "2026-03-01T00:00:00", "ingest": True, "requested_by": "me", "feeds": feeds})
    refused = json.dumps({"job_id": "j2", "requested_at": "2026-03-01T00:00:00Z", "ingest": True, "requested_by": "me", "feeds": [*feeds, {"feed_id": 0, "feed_url": "", "fetchprotection": 1}]})
    write_requests(spark.createDataFrame([(request,), ("{bad",), (refused,)], "payload string"), at("in"))
    responses = spark.createDataFrame([(1, 200, {"ETag": "e"}, RSS, None), (2, 0, {}, None, "timed out")], schemas.RESPONSE)
    tables = empty_tables(spark)
    flows.create_tables(tables, at("tables"))
    flows.scrape(spark, at("in"), lambda: responses, lambda: tables["scraping"], at("out"), at("ck1"), at("refused"), available_now=True, start="earliest")
    assert sorted(r.violations for r in spark.read.json(at("refused")).collect()) == [["feeds.feed_id", "feeds.feed_url"], ["json"]]
    append(spark.createDataFrame([("not json",)], "payload string"), at("out"), schemas.STREAM_CHECK)
    for checkpoint in ("ck2", "ck3"):  # the second reads all again
        flows.persist_results(spark, at("out"), at("tables"), at("bad"), at(checkpoint), available_now=True, start="earliest")
        get = lambda n: delta.read(spark, at("tables"), n)
        assert sorted((r.feed_id, r.status, r.queue_kind, r.error_message) for r in get("job_results").collect()) == [(1, "success", "ingest", None), (2, "error", "error", "timed out")]
        assert [(r.url, r.title) for r in get("articles").collect()] == [("https://papers.test/harbour", "Harbour notes")] and get("links").count() == 1
        assert get("jobs").first().status == "completed_with_errors"
        assert {r.feed_id: (r.etag, r.error_nbr) for r in get("scraping").collect()} == {1: ("e", 0), 2: (None, 1)}
    assert spark.read.json(at("bad")).select(F.col("violations")[0]).distinct().collect()[0][0] == "json"


def test_persist_stopped_anywhere_and_replayed(spark, tmp_path, monkeypatch):
    """A run that dies before any of its writes or its commit leaves all tables as they were; its replay counts once."""
    at = lambda *p: str(tmp_path.joinpath(*p))
    first = empty_tables(spark)
    first["scraping"] = spark.createDataFrame([(2, 1, None, None, 4, "old")], schemas.SCRAPING)
    flows.create_tables(first, at("tables"))
    failed = result("j1", 2, "error", error_message="timed out")
    messages = spark.createDataFrame([(failed, 7, schemas.STREAM_ERROR), ("{bad", 8, schemas.STREAM_ERROR)], "payload string, seq long, stream_name string")
    get = lambda n: rows_of(spark, at("tables"), n)
    before = {n: get(n) for n in NAMES}
    for stop in (2, 6):  # in the midst of six tables, before the commit
        calls = iter(range(9))

        def dying(real):
            def run(*args, **kwargs):
                if next(calls) == stop:
                    raise OSError("lost")
                return real(*args, **kwargs)

            return run

        with monkeypatch.context() as m:
            m.setattr(delta, "stage", dying(delta.stage))
            m.setattr(flows, "commit", dying(flows.commit))
            with pytest.raises(OSError):
                flows.persist_batch(spark, messages, at("tables"), at("bad"), ("ck", 0))
        assert {n: get(n) for n in NAMES} == before
    for _ in range(2):
        flows.persist_batch(spark, messages, at("tables"), at("bad"), ("ck", 0))
        assert delta.read(spark, at("tables"), "scraping").first().error_nbr == 5 and len(get("job_results")) == 1
        assert spark.read.json(at("bad")).count() == 1
    tmp_path.joinpath("tables", "_commits", "000000009999").write_text('{"numb')  # cut off
    assert len(get("job_results")) == 1
    delta.create(at("tables"), {"jobs": first["jobs"]})
    assert get("jobs") == before["jobs"] and len(get("job_results")) == 1


def test_arrival_order_in_every_cut(spark, tmp_path):
    """Jobs for one feed, in both orders and all cuts, against a plain loop over the messages."""
    jobs = [f"j{k}" for k in range(4)]
    entry = lambda k: {"title": f"title {k}", "url": "https://a/1", "summary": f"summary {k}" if k % 2 else None, "published_at": "2026-02-01T10:00:00+02:00"}
    said = [result(j, 1, "error" if k == 2 else "success", new_etag=None if k == 1 else f"e{k}", error_message="gone" if k == 2 else None, sources=[] if k == 2 else [entry(k)]) for k, j in enumerate(jobs)]
    for n, (order, size) in enumerate((([0, 1, 2, 3], 4), ([3, 2, 1, 0], 3), ([2, 0, 3, 1], 1))):
        etag = error = title = summary = None
        for k in order:
            etag = None if k == 1 and etag is None else etag if k == 1 else f"e{k}"
            error = "gone" if k == 2 else None
            if k != 2:
                title, summary = f"title {k}", f"summary {k}" if k % 2 else summary
        at = lambda *p, n=n, size=size: str(tmp_path.joinpath(f"{n}-{size}", *p))
        flows.create_tables(empty_tables(spark, 1, jobs), at("tables"))
        stream = F.when(F.get_json_object("payload", "$.status") == "error", schemas.STREAM_ERROR).otherwise(schemas.STREAM_INGEST)
        messages = spark.createDataFrame([(said[k],) for k in order], "payload string").withColumn("seq", F.monotonically_increasing_id()).coalesce(1).withColumn("stream_name", stream)
        arrived = {r.payload: i for i, r in enumerate(sorted(messages.collect(), key=lambda r: r.seq))}
        assert [arrived[said[k]] for k in order] == [0, 1, 2, 3]
        for number, low in enumerate(range(0, 4, size)):
            part = [(said[k], i, schemas.STREAM_ERROR if k == 2 else schemas.STREAM_INGEST) for i, k in enumerate(order)][low : low + size]
            random.Random(number).shuffle(part)
            flows.persist_batch(spark, spark.createDataFrame(part, "payload string, seq long, stream_name string"), at("tables"), at("bad"), ("ck", number))
        s, a = delta.read(spark, at("tables"), "scraping").first(), delta.read(spark, at("tables"), "articles").first()
        assert (s.etag, s.error_msg, s.error_nbr, a.title, a.summary, str(a.published_at)) == (etag, error, 1, title, summary, "2026-02-01 08:00:00")
        assert {r.job_id: r.status for r in delta.read(spark, at("tables"), "jobs").collect()} == {j: "completed_with_errors" if j == "j2" else "completed" for j in jobs}


def numbered(spark, first, n):
    return spark.range(first, first + n).select(F.col("id").cast("string").alias("payload"))


def test_log_batches_start_and_restart(spark, tmp_path):
    """A new group starts at the end; a segment of 1,000 messages comes in batches of 20; a restart goes on where it was."""
    at = lambda *p: str(tmp_path.joinpath(*p))
    append(numbered(spark, 0, 5), at("log"), "a")
    got: list[tuple[int, list[str]]] = []

    def run(most, start="latest", group="g", checkpoint="ck", fail=None, streams=("a", "b")):
        def batch(df, number):
            rows = [r.payload for r in df.orderBy("seq").collect()]
            if len(got) == fail and rows:
                raise OSError("lost")
            if rows:
                got.append((number, rows))

        return flows.run_batches(read_log(spark, at("log"), streams, group, most, start), batch, at(checkpoint), True)

    run(20)
    assert got == []  # what was there before the group is not read
    append(numbered(spark, 100, 1000).coalesce(1), at("log"), "a")
    for fail in (0, 7):  # the first batch as well
        with pytest.raises(Exception, match="lost"):
            run(20, fail=fail)
    assert [len(rows) for _, rows in got] == [20] * 7
    run(20)
    assert [len(rows) for _, rows in got] == [20] * 50 and [int(x) for _, rows in got for x in rows] == list(range(100, 1100))
    got.clear()
    append(numbered(spark, 2000, 3).repartition(3), at("log"), "b")
    append(numbered(spark, 3000, 30).repartition(4), at("log"), F.when(F.col("payload") % 2 == 0, "a").otherwise("b"))
    run(7)
    assert [len(rows) for _, rows in got] == [7, 7, 7, 7, 5] and sorted(int(x) for _, rows in got for x in rows) == [2000, 2001, 2002, *range(3000, 3030)]
    got.clear()
    run(None, "earliest", "other", "ck-other", streams=("a",))
    assert sorted(int(x) for _, rows in got for x in rows) == [*range(5), *range(100, 1100), *range(3000, 3030, 2)]
    got.clear()
    assert append(numbered(spark, 0, 0), at("log"), "a") is None
    run(20)
    assert got == []


def test_results_are_one_segment(spark, tmp_path):
    rows = spark.createDataFrame([("j", bool(k % 2), k, f"https://f/{k}", "error" if k == 3 else "success", None, None, None, 1, []) for k in range(1, 6)], schemas.RESULT)
    assert write_results(rows, str(tmp_path / "out")) == 1
    found = {(r.stream_name, json.loads(r.payload)["feed_id"]) for r in spark.read.json(str(tmp_path / "out" / "000000000001")).collect()}
    assert found == {("rss_ingest_results", 1), ("rss_check_results", 2), ("error_feeds_parsing", 3), ("rss_check_results", 4), ("rss_ingest_results", 5)}


def test_small_batches_write_little(spark, tmp_path):
    """A batch that touches 1% of the feeds writes under 5% of the bytes, and compaction changes nothing but the files."""
    folder, n = str(tmp_path / "tables"), 4000
    tables = empty_tables(spark, 1, ("j1", "j2"))
    ids = spark.range(1, n + 1)
    tables["feeds"] = ids.select("id", F.concat(F.lit("https://f/"), F.col("id")).alias("url"), F.lit("s").alias("section"), F.lit(True).alias("enabled"), F.lit(0.5).alias("trust_score"), F.lit(1).cast("long").alias("company_id"))
    tables["scraping"] = ids.select(F.col("id").alias("feed_id"), F.lit(1).alias("fetchprotection"), F.lit(None).cast("timestamp_ntz").alias("last_update"), F.sha2(F.col("id").cast("string"), 512).alias("etag"), F.lit(2).alias("error_nbr"), F.lit(None).cast("string").alias("error_msg"))
    flows.create_tables(tables, folder)
    size = lambda c, name: {e[0]: 0 for u in c["tables"][name].values() for e in u} and sum(e[1] for u in c["tables"][name].values() for e in u)
    before = last_commit(spark, folder)
    # feeds of one bucket: a batch of one per cent of the feeds
    few = [r.feed_id for r in delta.read(spark, folder, "scraping", units=["5"]).orderBy("feed_id").limit(n // 100).collect()]
    for number, status in enumerate(("success", "error")):
        part = [(result(f"j{number + 1}", f, status, error_message="bad" if number else None), k, schemas.STREAM_ERROR if number else schemas.STREAM_INGEST) for k, f in enumerate(few)]
        after = flows.persist_batch(spark, spark.createDataFrame(part, "payload string, seq long, stream_name string"), folder, str(tmp_path / "bad"), ("ck", number))
        assert 0 < size(after, "scraping") - size(before, "scraping") < 0.05 * size(before, "scraping")
        assert [u for u in after["tables"]["scraping"] if after["tables"]["scraping"][u] != before["tables"]["scraping"][u]] == ["5"]
        before = after
    want = {n: rows_of(spark, folder, n) for n in NAMES}
    assert len(want["scraping"]) == n and sum("error_nbr=3" in r for r in want["scraping"]) == len(few)
    assert delta.compact(spark, folder, "scraping", 2) == ["5"] and delta.compact(spark, folder, "scraping", 2) == []
    assert len(last_commit(spark, folder)["tables"]["scraping"]["5"]) == 1 and {n: rows_of(spark, folder, n) for n in NAMES} == want


def test_keyed_state_against_tables(spark, tmp_path, monkeypatch):
    """Seen keys and error counters in the state store: the same tables as by look-ups, over a restart and a replay, and
    job_results is not read."""
    at = lambda *p: str(tmp_path.joinpath(*p))
    first = empty_tables(spark, 3, ("j0", "j1", "j2"))
    first["scraping"] = spark.createDataFrame([(2, 1, None, None, 4, "old")], schemas.SCRAPING)
    first["job_results"] = spark.createDataFrame([("j0", 3, "success", "ingest", None, 1, None, None, None)], schemas.JOB_RESULT)
    entry = {"title": "t", "url": "https://a/1", "published_at": "2026-02-01T10:00:00Z"}
    said = [result("j0", 3, "error"), result("j0", 2, "error", error_message="a"), "{bad", result("j1", 2, "error", error_message="b"), result("j0", 2, "success"), result("j1", 1, sources=[entry]), result("j1", 1, "error")]
    stream = F.when(F.get_json_object("payload", "$.status") == "error", schemas.STREAM_ERROR).otherwise(schemas.STREAM_INGEST)
    for k in (0, 4):
        append(spark.createDataFrame([(m,) for m in said[k : k + 4]], "payload string").coalesce(1), at("log"), stream)
    for way in ("tables", "state"):
        flows.create_tables(first, at(way))
    flows.persist_results(spark, at("log"), at("tables"), at("bad"), at("ck1"), available_now=True, start="earliest", most=None)
    persist, read, opened = flows.persist_checked, delta.read, set()
    later = flows.__dict__

    def fails(*args, **kwargs):
        raise OSError("lost")

    from tidemill.streaming import state

    with monkeypatch.context() as m:
        m.setitem(later, "persist_checked", fails)
        with pytest.raises(Exception, match="lost"):
            state.persist_results(spark, at("log"), at("state"), at("bad2"), at("ck2"), available_now=True, start="earliest", most=5)
    with monkeypatch.context() as m:
        m.setitem(later, "persist_checked", lambda *a, **k: (m.setattr(delta, "read", lambda s, f, name, *x, **y: (opened.add(name), read(s, f, name, *x, **y))[1]), persist(*a, **k))[1])
        state.persist_results(spark, at("log"), at("state"), at("bad2"), at("ck2"), available_now=True, start="earliest", most=5)
    assert "scraping" in opened and "job_results" not in opened
    assert {n: rows_of(spark, at("state"), n) for n in NAMES} == {n: rows_of(spark, at("tables"), n) for n in NAMES}
    assert {r.feed_id: r.error_nbr for r in delta.read(spark, at("state"), "scraping").collect()} == {1: 0, 2: 6}
    assert spark.read.json(at("bad2")).count() == 1


def test_articles_of_one_url_and_date_stay_apart(spark, tmp_path):
    """As those without a date may be in a table from before; a batch changes both."""
    folder, tables = str(tmp_path / "tables"), empty_tables(spark)
    tables["articles"] = spark.createDataFrame([(i, "old", None, None, "https://a", None, None) for i in (1, 2)], schemas.ARTICLE).withColumn("published_at", schemas.epoch())
    flows.create_tables(tables, folder)
    part = [(result("j1", 1, sources=[{"title": "new", "url": "https://a"}]), 1, schemas.STREAM_INGEST)]
    flows.persist_batch(spark, spark.createDataFrame(part, "payload string, seq long, stream_name string"), folder, str(tmp_path / "bad"), ("ck", 0))
    told = lambda name, *columns: sorted(tuple(r) for r in delta.read(spark, folder, name).select(*columns).collect())
    assert told("articles", "id", "title") == [(1, "new"), (2, "new")] and told("links", "source_id", "feed_id") == [(1, 1), (2, 1)]
