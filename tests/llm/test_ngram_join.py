import re
from collections import Counter

from tidemill.llm.components import components
from tidemill.llm.ngram_join import least_matches, near_duplicates, one_of_each, op7


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """rows of distinct ids: {doc_id: (class_id, n_links)}."""
    rows = sorted(rows)
    sets = {d: shingles(t) for d, t in rows}
    root, links = {d: d for d in sets}, Counter()

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if (s or "") == (t or "") or (inter and 5 * inter >= 4 * (len(sets[a]) + len(sets[b]) - inter)):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in sets}


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in op7(spark, small).collect()} == want
    assert any(n for _, n in want.values())


def test_large_group_in_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base + [f"tail{i}"])) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(5)] + [(200, "short text"), (201, "short text"), (202, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (7, 256):
        assert {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs, block=block).collect()} == brute(rows)
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == [0, 200, 202]


def test_component_of_many_sizes(spark):
    """One passage joins texts of all sizes; classes of size keep the pairs at the threshold, its exact edge included."""
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"own{j}" for j in range(i * 2 // 3)])) for i in range(90)] + [(100 + i, " ".join(shared[:12] * (i + 1))) for i in range(6)]
    rows += [(200, " ".join(f"e{i}" for i in range(104))), (201, " ".join(f"e{i}" for i in range(84)))]  # 80 of 100 shingles
    want = brute(rows)
    assert want[200] == (200, 1) and len({c for c, _ in want.values()}) < 10
    for block in (5, 16):
        assert {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()} == want


def test_messy_rows(messy, empty):
    out = near_duplicates(messy).collect()
    assert len(out) == messy.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert (by[1].class_id, by[2].class_id, by[2].kept) == (1, 1, False)
    assert by[9].class_id == by[11].class_id == 9 and by[6].class_id == by[7].class_id == 6
    assert by[3].class_id == by[4].class_id == 3, "null and empty texts are equal"
    assert all(r.class_id is None and r.n_links == 0 for r in out if r.doc_id is None)
    assert {r.class_id for r in out if r.doc_id == 8} == {8}, "texts under one id are one document"
    assert near_duplicates(empty).collect() == []
    assert one_of_each(messy).columns == messy.columns


def test_one_row_of_each_class_stays(messy):
    kept = one_of_each(messy).collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids == {1: 1, 3: 1, 5: 1, 6: 1, 8: 1, 9: 1, 10: 1, None: 1}
    assert [r.text for r in kept if r.doc_id is None] == ["A text without an id. A text without an id."], "the null text is a copy of 3"
    again = one_of_each(messy.unionByName(messy).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, kept))


def test_pruning_bound():
    least = least_matches(0.8, 1e-5, 16)
    assert list(least) == sorted(least) and 0 < least[0] < 16 * 0.8 and least[-1] < 128 * 0.8


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(80)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_stars_end_in_one_round(spark, monkeypatch):
    """Hubs are the smallest nodes of their bands; a round costs the driver three plans and a dozen stages."""
    from tidemill.llm import components as module

    stored = []
    monkeypatch.setattr(module, "store", lambda df, name, keep=module.store: stored.append(name) or keep(df, name))
    edges = [(hub, hub + k) for hub in (0, 10_000, 20_000) for k in range(1, 1_000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: n // 10_000 * 10_000 for e in edges for n in e}
    assert stored == ["edges", "pointers", "edges", "labels"]


def test_pointers_of_many_rounds_are_followed(spark, monkeypatch):
    from tidemill.llm import components as module

    monkeypatch.setattr(module, "AT_ONCE", 2)
    edges = [(k, k + 1) for k in range(1, 700)] + [(k, 5_000 - k) for k in range(1_000, 1_050)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 701)} | {n: k for k in range(1_000, 1_050) for n in (k, 5_000 - k)}
