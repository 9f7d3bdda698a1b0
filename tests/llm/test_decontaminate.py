import random

from tidemill.llm.decontaminate import contaminated, op3, runs, stage, tiles
from tidemill.llm.text_arrays import mix

import numpy as np


def brute_tiles(item, text, least):
    """Total length of greedy tiles, by looking for the longest free match again and again."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        out.append((i, j, n))


def test_tiles_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        a, b = (mix(np.array(x, np.uint64) + np.uint64(9)) if x else np.zeros(0, np.uint64) for x in (item, text))
        got, want = tiles(a, b, 3), brute_tiles(item, text, 3)
        assert sorted(n for *_, n in got)[-1:] == sorted(n for *_, n in want)[-1:]
        assert got == want


def test_runs_in_pieces():
    """However few matches are listed at once, runs are the same."""
    rng = np.random.default_rng(3)
    for symbols in (1, 2, 5):
        a, b = rng.integers(0, symbols, 30).astype(np.uint64), rng.integers(0, symbols, 70).astype(np.uint64)
        whole = sorted(zip(*(x.tolist() for x in runs(a, b)), strict=True))
        assert all(sorted(zip(*(x.tolist() for x in runs(a, b, most)), strict=True)) == whole for most in (1, 7, 100))


def test_very_long_text_of_one_token(spark):
    docs = spark.createDataFrame([(1, "ha " * 100_000), (2, "ha " * 100 + "ho")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "ha " * 300)], "item_id long, text string")
    for most_seeds in (500_000, 1):
        assert [(r.doc_id, r.coverage, r.tiles) for r in contaminated(docs, bench, most_seeds=most_seeds).collect()] == [(1, 1.0, 1)]


def test_benchmark_beyond_the_bound(spark, small):
    """Seeds joined as tables give the pairs of the seeds sent to all tasks, repeated rows and items included."""
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    docs, bench = docs.unionByName(docs.filter("doc_id % 7 = 0")), bench.unionByName(bench.filter("item_id % 3 = 0"))
    for threshold in (0.2, 0.6):
        sent, joined = (sorted(map(tuple, contaminated(docs, bench, threshold=threshold, most_seeds=m).collect())) for m in (500_000, 1))
        assert sent == joined and sent


def test_reordered_and_changed_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    w = item.split()
    rows = [(1, "before " + item + " after"), (2, " ".join(w[8:] + ["and", "then"] + w[:8])), (3, item.upper().replace(" ", ", ")), (4, " ".join(w[:6])), (5, "nothing shared at all"), (6, None), (7, ""), (8, item), (8, item)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(70, item), (71, "too short"), (72, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in contaminated(docs, bench).collect())
    assert got == [(1, 70, 1.0), (2, 70, 1.0), (3, 70, 1.0), (8, 70, 1.0), (8, 70, 1.0)]
    assert contaminated(docs, bench, threshold=0.3).count() == 6
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in contaminated(docs, bench, most_seeds=20).collect()) == got


def test_query_finds_whole_items(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet").collect(), spark.read.parquet(f"{small}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in op3(spark, small).collect()}
    whole = {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text}
    assert whole <= found and len(found) <= len(whole) + 3 and whole


def test_messy_rows(spark, messy, empty, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert contaminated(messy, bench).collect() == [] and contaminated(empty, bench).collect() == [] and contaminated(messy, bench.limit(0)).collect() == []
    assert contaminated(messy, bench, most_seeds=1).collect() == [] and contaminated(empty, bench, most_seeds=1).collect() == []
    out = stage(spark, messy.withColumn("_", messy.node), small)
    assert out.columns == [*messy.columns, "_"] and out.count() == messy.count()
