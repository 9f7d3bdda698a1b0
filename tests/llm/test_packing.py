import zlib
from collections import defaultdict
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from tidemill.llm.packing import WordEncoder, default_tokenizer, nnls, op10, pack, plan


@cache
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    e = tokenizer().encode(text or "", add_special_tokens=False)
    return [*e.ids, 2]


def check(rows, out, window):
    """Each id in one piece; sequences gapless and within the window. Returns the number of sequences."""
    want = sorted((d, len(ids)) for d, ids in rows)
    assert sorted((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == want
    ids = dict(rows)
    sequences = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(len(i) for _, i in rows)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


def test_query_round_trip(spark, small):
    rows = [(r.doc_id, ids_of(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    n = check(rows, op10(spark, small).collect(), 4096)
    assert n <= 1.06 * sum(len(i) for _, i in rows) / 4096 + 2


def test_messy_rows(spark, messy, empty):
    rows = messy.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = [(r.doc_id, ids_of(r.text)) for r in rows.collect()]
    check(want, pack(rows, default_tokenizer(), window=256, grain=4).collect(), 256)
    out = pack(messy, default_tokenizer()).collect()
    assert sum(r.length for r in out) == sum(len(ids_of(r.text)) for r in messy.collect())
    assert pack(empty, default_tokenizer()).collect() == []


def test_words_encode_as_whole_texts():
    texts = ["It's don't WE'LL 'sx !'s a_b 12x", "x<|endoftext|>y", "İX ß é Σας ΑΣ", "½ ² a b\x1cc", "", "日本 ́e é", "a\tb\r\nc   d", "<| x |>"]
    whole = tokenizer()
    enc = WordEncoder(default_tokenizer(), most=12)
    for _ in range(2):
        assert [list(np.frombuffer(b, "<u4")) for b in enc.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_least_squares_and_plan():
    rng = np.random.default_rng(3)
    columns = rng.integers(0, 13, (40, 3))
    weight, b = np.append(0, rng.random(12) + 0.1), np.append(0, rng.integers(0, 50, 12))
    a = np.stack([np.bincount(c, minlength=13) * weight for c in columns], axis=1)
    x = nnls(columns, weight, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-5).all() and np.allclose(slope[x > 0], 0, atol=1e-4)
    histogram = np.concatenate([[0], rng.integers(0, 200, 64)])
    used = np.zeros(65, int)
    for combo, n in plan(histogram):
        assert sum(combo) <= 64 and n > 0
        for c in combo:
            used[c] += n
    assert (used == histogram).all()


def test_short_texts_fill_their_windows(spark):
    rows = [(i, " ".join(["one"] * (16 if i % 3 else 19))) for i in range(2_000)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string"), default_tokenizer(), window=512).collect()
    n = check([(d, ids_of(t)) for d, t in rows], out, 512)
    assert n <= 1.05 * sum(len(ids_of(t)) for _, t in rows) / 512 + 1


def test_what_a_worker_remembers_is_bounded():
    enc = WordEncoder(default_tokenizer())
    letters = str.maketrans("0123456789", "abcdefghij")
    for lo in range(0, 560_000, 20_000):
        text = " ".join(f"w{k}".translate(letters) for k in range(lo, lo + 20_000))
        (ids,) = enc.encode([text])
        assert len(enc.known) <= 200_000 and len(enc.stretches) <= 500_000
    e = enc.tokenizer.encode(text, add_special_tokens=False)
    assert np.frombuffer(ids, "<u4").tolist() == e.ids
