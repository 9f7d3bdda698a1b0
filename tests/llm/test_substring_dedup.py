import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import substring_dedup
from tidemill.llm.substring_dedup import FILTER_BITS, bucket_filter, collected, filter_places, op6, remove_repeated, repeated_spans


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, k):
    """(doc_id, n_words, n_removed, kept) of each row."""
    seen = Counter(tuple(w[i : i + k]) for _, t in rows for w in [words(t)] for i in range(len(w) - k + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = Counter({(d, n, g, hashlib.sha256(t.encode()).hexdigest()): c for (d, n, g, t), c in brute(rows, 35).items()})
    assert Counter(tuple(r) for r in op6(spark, small).collect()) == want
    assert any(g for _, _, g, _ in want)


@pytest.mark.parametrize("options", [{}, {"hot_rows": 2}, {"hot_rows": 2, "seed": 4}])
def test_small_windows_cold_and_hot(spark, small, options):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(remove_repeated(docs, window=8, **options)) == brute(rows, 8)


def test_messy_rows(spark, messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert got(remove_repeated(messy, window=35)) == brute(rows, 35)
    assert got(remove_repeated(messy, window=6)) == brute(rows, 6)
    assert remove_repeated(empty).collect() == []


def test_spans_of_repeated_rows_are_collected_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text)] * 30 + [(None, text)] * 30 + [(6, f"{text} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = collected(repeated_spans(docs, 35)).collect()
    assert len(found) == 3 and all(len(r.spans) == len(set(r.spans)) for r in found)
    assert got(remove_repeated(docs, 35)) == brute(rows, 35)


def test_passage_shared_by_texts_of_different_batches(spark):
    """Each text is a slice of its own, and has the passage once: only the counts over all of them tell that it is hot."""
    passage = " ".join(f"shared{i}" for i in range(50))
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(25_000)) + " " + passage) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    assert got(remove_repeated(docs, 35, hot_rows=3)) == brute(rows, 35)


def test_filter_keeps_back_what_occurs_once_and_nothing_else(spark, monkeypatch):
    once, twice = np.arange(1, 3_000, dtype=np.int64) ** 3, np.arange(5_000, 6_000, dtype=np.int64) ** 3
    bits = bucket_filter(spark.createDataFrame([(int(b),) for b in twice], "bucket long"))
    inside = lambda b: ((bits[filter_places(b) >> 6] >> (filter_places(b) & 63).astype(np.uint64)) & np.uint64(1)).all(0)
    assert inside(twice).all() and inside(once).mean() < 0.01
    full = np.full(FILTER_BITS // 64, 2**64 - 1, np.uint64)
    monkeypatch.setattr(substring_dedup, "bucket_filter", lambda _: full)
    rows = [(i, " ".join(f"w{(i % 3) * 7 + j}" for j in range(60))) for i in range(9)]
    assert got(remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 35)) == brute(rows, 35)
