"""Every registered query with SQL against DuckDB on the same files."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import DATA
from tidemill.functions import text
from tidemill.operators import results
from tidemill.plans import queries
from tidemill.plans.testbed import tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_against_sql(spark, duck, small, name):
    df = __spark_entry__.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    told = duck.execute(f"select {', '.join(columns)} from ({__spark_entry__.oracle_sql()[name]}) t")
    want = sorted((tuple(plain(v) for v in r) for r in told.fetchall()), key=repr)
    assert got == want
    kinds = {r[0]: r[1].split("(")[0] for r in duck.execute(f"describe {__spark_entry__.oracle_sql()[name]}").fetchall()}
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_all_have_sql():
    assert all(q in __spark_entry__.oracle_sql() for q in __spark_entry__.queries() if q.startswith("q_"))


def test_persist_digests_all_tables(spark, small):
    article, link = tables(spark, small, "article", "link")
    rows = {r.table_name: r.n_rows for r in __spark_entry__.queries()["q_persist_tables"](spark, small).collect()}
    assert set(rows) == {"job_results", "scraping", "jobs", "articles", "links"}
    assert rows["articles"] > article.count() and rows["links"] > link.count()


def test_upsert_takes_all_lines(spark, small):
    last = spark.read.parquet(f"{small}/lineitem.parquet").filter("l_linenumber > 2 and l_orderkey % 7 <> 0").selectExpr("concat('t', l_partkey) as title", "concat('https://n.example.com/', l_orderkey % 7001) as url")
    out = __spark_entry__.queries()["q_article_upsert_all"](spark, small)
    assert out.join(last, ["title", "url"], "left_semi").count() > __spark_entry__.queries()["q_article_upsert"](spark, small).join(last, ["title", "url"], "left_semi").count()


def test_upsert_takes_the_last_of_equal_numbers(spark, small, tmp_path):
    """By the order of the table's files, not by that in which Spark reads them (large ones first)."""
    rows = spark.read.parquet(f"{small}/lineitem.parquet")
    one = rows.filter("l_orderkey = 1").limit(1).withColumn("l_linenumber", F.lit(2)).withColumn("l_suppkey", F.lit(2).cast("long"))
    numbered = lambda n: one.withColumn("l_partkey", F.lit(n).cast("long"))
    for t in ("orders", "lineitem"):
        (tmp_path / f"{t}.parquet").mkdir()
    (tmp_path / "orders.parquet" / "a.parquet").symlink_to(f"{small}/orders.parquet")
    numbered(5).toPandas().to_parquet(tmp_path / "lineitem.parquet" / "a.parquet", coerce_timestamps="us")
    rows.filter("l_orderkey > 1").unionByName(numbered(7)).toPandas().to_parquet(tmp_path / "lineitem.parquet" / "b.parquet", coerce_timestamps="us")
    for lines in ("l_linenumber <= 2", "true"):
        got = results.fold_articles(queries._article_messages(spark, str(tmp_path), lines)).filter("url like '%/1'")
        assert [(r.title, r.summary) for r in got.collect()] == [("t7", "s7")]


def test_parts_of_shuffles_follow_the_tables(spark, small, monkeypatch):
    """More parts for more bytes, never fewer than set; a task's share is bounded, and smaller ones stay."""
    from tidemill.plans import testbed

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in names}
    try:
        tables(spark, small, "article")
        assert spark.conf.get(names[0]) == before[names[0]] and int(spark.conf.get(names[1])) == testbed.TASK_BYTES
        spark.conf.set(names[1], "1m")
        monkeypatch.setattr(testbed, "PART_BYTES", 1 << 15)
        tables(spark, small, "article")
        assert int(spark.conf.get(names[0])) > 10 and spark.conf.get(names[1]) == "1m"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_references_cut_short(spark, tmp_path):
    """q_strip_html leaves those that its SQL leaves, and resolves any that is closed; strip_html resolves both kinds."""
    pages = ["<p>token = &quot</p> p{}", "a &lt b &gt", "&copy 2024 &copy;", "x&amp y&amp;quot; &ampquot; &ampz", "&quotx; &#39 it&#39;s", "&quo &", "&quot;said&quot; &middot;,", None, ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.stripped for r in __spark_entry__.queries()["q_strip_html"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(queries.SQL_BASE["q_strip_html"]).fetchall())
    both = spark.createDataFrame([("caf&eacute; &quot",)], "h string").select(text.strip_html(F.col("h"), closed=True), text.strip_html(F.col("h")))
    assert tuple(both.first()) == ("café &quot", 'café "')
