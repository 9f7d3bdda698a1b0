"""The engine's tables derived from a star schema of orders, parts, suppliers and events, as the same SQL for any engine.

Orders, line items, parts and suppliers have the shapes of articles, links, feeds and companies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]

#: {ts} is the engine's name of a timestamp without a zone; each view may use those before it.
VIEWS = {
    "company": """select s_suppkey+1 as id, s_name as name,
        case when s_suppkey%11=0 then null else concat('www.s',s_suppkey,'.Example.com:8080/x') end as host,
        case when s_suppkey%4=0 then null else concat('/icons/',s_suppkey,'.png') end as icon_url,
        lower(substr(r_name,1,2)) as country, 'en' as language, cast(s_suppkey%3 as int) as fetchprotection, s_acctbal>=0 as enabled
        from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    "feed": """select p_partkey+1 as id, concat('https://feeds.example.com/',p_partkey,'.xml') as url, p_type as section,
        p_size%5<>0 as enabled, cast(p_size/50.0 as double) as trust_score, case when p_partkey%17=0 then null else sk+1 end as company_id
        from part left join (select l_partkey, min(l_suppkey) as sk from lineitem group by l_partkey) m on l_partkey=p_partkey""",
    "scraping": """select p_partkey+1 as feed_id, cast(p_partkey%3 as int) as fetchprotection,
        case when p_partkey%5=0 then null else {ts} '2020-01-01 00:00:00' + p_partkey * interval '1' hour end as last_update,
        case when p_partkey%7=0 then null else concat('e',p_partkey%10) end as etag, cast(p_partkey%2 as int) as error_nbr,
        case when p_partkey%2=1 then 'old error' end as error_msg from part where p_partkey%4<>0""",
    "tag": "select distinct cast(regexp_extract(p_brand,'([0-9]+)',1) as bigint) as id, lower(p_brand) as name from part",
    "feed_tag": "select p_partkey+1 as feed_id, cast(regexp_extract(p_brand,'([0-9]+)',1) as bigint) as tag_id from part",
    "article": """select o_orderkey+1 as id, concat('https://n.example.com/',o_orderkey%7001) as url, o_orderpriority as title,
        case when o_orderkey%3=0 then null else concat('summary ',o_orderkey) end as summary,
        case when o_orderkey%4=0 then null else concat('author ',o_orderkey%100) end as author,
        case when o_orderkey%50=0 then {ts} '1970-01-01 00:00:00' else o_orderdate + o_orderkey * interval '1' second end as published_at,
        case when o_orderkey%6=0 then null else concat('https://i.example.com/',o_orderkey,'.jpg') end as image_url from orders""",
    "link": """select distinct l_orderkey+1 as source_id, l_partkey+1 as feed_id, a.published_at
        from lineitem join article a on a.id=l_orderkey+1""",
    "result_msg": """select event_id as seq, concat(user_id,'-',day(ts)) as job_id, user_id,
        cast(regexp_extract(props,'([0-9]+)',1) as bigint)%20+1 as feed_id,
        case event_type when 'error' then 'error_feeds_parsing' when 'view' then 'rss_check_results'
          when 'click' then 'rss_check_results' else 'rss_ingest_results' end as stream_name,
        case event_type when 'error' then 'error' when 'view' then 'not_modified' else 'success' end as status,
        case event_type when 'error' then concat('failed ',event_id) end as error_message,
        case when event_id%3=0 then null else concat('n',event_id) end as new_etag,
        case when event_id%4=0 then null else ts end as new_last_update, cast(event_id%3 as int) as fetchprotection, ts as processed_at from events""",
    "job": """select job_id, cast(count(distinct feed_id) + case when user_id%5=0 then 1 else 0 end as int) as feed_count
        from result_msg where user_id%13<>0 group by job_id, user_id
        union all select concat('empty-',n_nationkey) as job_id, cast(n_nationkey%2 as int) as feed_count from nation""",
    "job_feed": """select distinct job_id, feed_id, concat('https://feeds.example.com/',feed_id,'.xml') as feed_url from result_msg where user_id%13<>0
        union all select concat('empty-',n_nationkey) as job_id, cast(1 as bigint) as feed_id, 'https://feeds.example.com/1.xml' as feed_url from nation where n_nationkey%2=1""",
    "job_result": """select job_id, feed_id, status, stream_name, error_message from
        (select m.*, row_number() over (partition by m.job_id, m.feed_id order by seq) as rn from result_msg m where user_id%13<>0) x where rn=1""",
    "response": """select p_partkey+1 as feed_id, cast(case when p_partkey%9=0 then 304 else 200 end as int) as status_code,
        case when p_partkey%5=1 then concat('e',p_partkey%10) when p_partkey%5=2 then concat('x',p_partkey) end as etag,
        case when p_partkey%3=0 then {ts} '2020-01-01 00:00:00' + p_partkey * interval '1' hour when p_partkey%3=1 then {ts} '2021-06-01 00:00:00' end as last_modified,
        case when p_partkey%6=0 then {ts} '2019-01-01 00:00:00' end as parsed_last_modified,
        case when p_partkey%23=0 then 'timed out' end as error, case when p_partkey%19=0 then 'not well-formed' end as parse_error from part""",
    "entry": """select l_partkey+1 as feed_id, concat('j',l_suppkey%7) as job_id, l_orderkey*10+l_linenumber as entry_pos,
        case when l_orderkey%31=0 then null else concat('  title ',l_orderkey%97,' ') end as title,
        case when l_orderkey%37=0 then ' ' else concat('https://n.example.com/',l_orderkey%50) end as url,
        case when l_orderkey%41=0 then null else l_shipdate end as published_at from lineitem""",
}


#: Bytes of Parquet for which there is one more part in a shuffle, and bytes of a shuffle that one task reads at most, on average. Keys
#: and dates of lines and orders take some thirty times as much memory as they take in shuffle files.
PART_BYTES, TASK_BYTES = 8 << 20, 16 << 20


def spread(spark: SparkSession, sf_dir: str) -> int:
    """Let the parts of shuffles grow in number with the tables, so that they do not grow in size; the number. Settings that make
    smaller parts stay."""
    size = 0
    for name in BASE:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    if now > TASK_BYTES:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    return parts


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views over the Parquet files of sf_dir."""
    spread(spark, sf_dir)
    known: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in known:
            known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet") if name in BASE else spark.sql(*_bound(name))
        return known[name]

    def _bound(name: str):
        text = VIEWS[name].replace("{ts}", "timestamp_ntz")
        used = [n for n in [*BASE, *VIEWS] if n != name and _mentions(text, n)]
        for n in used:
            get(n).createOrReplaceTempView(f"_tb_{n}")
        return (_renamed(text, {n: f"_tb_{n}" for n in used}),)

    return [get(n) for n in names]


def _mentions(text: str, name: str) -> bool:
    return any(f"{word} {name}{end}" in f"{text} " for word in ("from", "join") for end in (" ", "\n", ")"))


def _renamed(text: str, to: dict[str, str]) -> str:
    text = f"{text} "
    for name, new in to.items():
        for word in ("from", "join"):
            for end in (" ", "\n", ")"):
                text = text.replace(f"{word} {name}{end}", f"{word} {new}{end}")
    return text


def oracle(sql: str) -> str:
    """SQL that may use the views, for an engine that knows the base tables only."""
    ctes = ",\n".join(f"{n} as ({t.replace('{ts}', 'timestamp')})" for n, t in VIEWS.items())
    return f"with {ctes}\n{sql}"
