"""Verdicts against a plain tree, rules against plain string tests."""

import re
from collections import defaultdict

import pytest

from tests.conftest import DATA
from tidemill.llm import url_filter


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [(len(r), -k, r, v) for k, (v, r) in enumerate(rules) if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[len(r.split("/")[0]) :])]
    return max(fits)[2:] if fits else (None, None)


def segments(path, depth):
    if not path:
        return ()
    raw = (path[1:] if path[0] == "/" else path).split("/")
    form = lambda s: "<long>" if len(s) > 40 else "<x>" if re.fullmatch("[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s) and re.search("[a-fA-F]", s) else re.sub("[0-9]+", "<d>", s)
    out = [form(s) for s in raw[:depth]]
    return tuple(out[:-1] + ["<rest>"] if len(raw) > depth else out)


def kind(s, k):
    if k >= len(s):
        return 0
    return 1 if s[k] == "" else 2 if s[k] == "<d>" else 3 if re.fullmatch(r"[^<>\d.]+", s[k]) else 4


def plain(urls, rules, least=20, share=0.05, alike=0.05, depth=8, reject=0.9):
    """(host, path, rule, verdict, template) of each url, by recursion over nodes."""
    rows = [(*(hp := parsed(u)), *rule_of(*hp, rules), segments(hp[1], depth)) for u in urls]
    template = {}

    def grow(members, name, k):
        branches = defaultdict(list)
        for i in members:
            if k < len(rows[i][4]):
                branches[rows[i][4][k]].append(i)
            else:
                template[i] = name
        whole = sum(map(len, branches.values()))
        own = []
        for s, m in branches.items():
            if len(m) >= least and len(m) >= share * whole:
                own.append((s, [sum(kind(rows[i][4], k + 1) == j for i in m) for j in range(5)], [sum(rows[i][3] == v for i in m) for v in ("block", "allow", None)]))
        names = url_filter.merged(own, alike)
        joined = defaultdict(list)
        for s, m in branches.items():
            joined[names.get(s, "*")] += m
        for b, m in joined.items():
            grow(m, f"{name}/{b}", k + 1)

    hosts = defaultdict(list)
    for i, r in enumerate(rows):
        hosts[r[0]].append(i)
    for members in hosts.values():
        grow(members, "", 0)
    seen = defaultdict(list)
    for i, r in enumerate(rows):
        seen[r[0], template[i]].append(r[3])
    bad = {t: (v.count("block") + 1) / (v.count("block") + v.count("allow") + 2) >= reject for t, v in seen.items()}
    return [(h, p, r, v or ("block" if bad[h, template[i]] else "allow"), template[i]) for i, (h, p, r, v, _) in enumerate(rows)]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query(spark, size):
    pages = spark.read.parquet(f"{DATA}/{size}/pages.parquet").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template) for r in url_filter.op11(spark, f"{DATA}/{size}").collect()}
    assert got == dict(zip((p.page_id for p in pages), plain([p.url for p in pages], url_filter.RULES), strict=True))


def test_learned_templates(spark, monkeypatch):
    """Words that vary become wildcards, like branches are merged, and pure templates are rejected beyond the rules."""
    monkeypatch.setattr(url_filter, "_OFTEN", 7)  # both ways of each join
    rules = [("block", "shop.test/buy/red-"), ("allow", "shop.test/help/")]
    urls = [f"https://shop.test/buy/{'red' if k % 20 else 'blue'}-{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}" for k in range(600)]
    urls += [f"https://shop.test/{'help' if k % 2 else 'about'}/{k}.html" for k in range(300)] + [f"http://news.test/{'abc'[k % 3]}/{k}/f{k:06x}aa" for k in range(300)]
    urls += [None, "", "no scheme", "x://", "x://H?a=/b", "https://[::1]:80/a//b/", "https://Ä.TEST/" + "a/" * 30 + "1", "http://shop.test/" + "z" * 20_000, "http://shop.test/buy", *["http://one.test/a"] * 3, "a://b://c"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template) for r in url_filter.judge(df, rules, keep=["page_id"]).collect()}
    want = plain(urls, rules)
    assert [got[k] for k in range(len(urls))] == want
    assert got[20][2:] == (None, "block", "/buy/*") and got[602][3:] == ("allow", "/about/<d>.html") and got[900][4].startswith("/{a|b|c}/<d>")
    assert url_filter.judge(df.limit(0), rules, keep=["page_id"]).collect() == []
    assert url_filter.judge(df.limit(0), []).columns == ["host", "path", "rule", "verdict", "template", "purity"]
