import itertools
import zlib

import numpy as np
import pytest

from tidemill.llm.language_id import Letters, fit, identify, op5, viterbi, word_scores

EN = "the cat sat on the mat and then the dog came with this thing that they have seen there"
FR = "le chat est sur la table avec des amis qui sont dans une maison où ils ont vu leur chien"
RU = "кот сидел на окне и смотрел как собака бежит по улице"


@pytest.fixture(scope="module")
def model():
    return fit([(EN, "en"), (EN + " again", "en"), (FR, "fr"), (FR + " encore", "fr"), (RU, "ru")])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    scores = (rng.normal(size=(18, 3)) * 3).astype(np.float32)
    lo, hi = np.array([0, 0, 7, 13]), np.array([0, 7, 13, 18])
    labels = viterbi(scores, lo, hi, 1.5)
    value = lambda s, path: sum(float(s[i, j]) for i, j in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))
    for a, b in zip(lo, hi, strict=True):
        if b > a:
            assert value(scores[a:b], labels[a:b]) == pytest.approx(max(value(scores[a:b], p) for p in itertools.product(range(3), repeat=int(b - a))), abs=1e-4)


def test_scripts_narrow_candidates(model):
    s = word_scores(Letters(["кот chat"]), model)
    ru = model.languages.index("ru")
    assert np.isinf(s[0]).tolist() == [j != ru for j in range(3)] and np.isinf(s[1, ru])


def test_spans_of_mixed_texts(spark, model):
    docs = spark.createDataFrame([(1, f"{EN}. {FR}! {RU}"), (2, EN.upper()), (3, None), (4, "12 34 !?"), (5, "кот"), (5, "кот")], "doc_id long, text string")
    out = {r.doc_id: r for r in identify(docs, model).collect()}
    spans = [(s.lang, s.first_word, s.words) for s in out[1].spans]
    n = [len(EN.split()), len(FR.split()), len(RU.split())]
    assert [s[0] for s in spans] == ["en", "fr", "ru"] and sum(s[2] for s in spans) == sum(n)
    assert abs(spans[1][1] - n[0]) <= 2 and spans[2][1] == n[0] + n[1]
    assert (out[2].lang_pred, out[2].score) == ("en", 1.0) and out[5].lang_pred == "ru"
    assert [(out[i].lang_pred, out[i].score, out[i].spans) for i in (3, 4)] == [("und", 0.0, [])] * 2


def test_messy_rows(spark, messy, empty, model):
    out = identify(messy, model).collect()
    assert len(out) == messy.count() and all(0 <= r.score <= 1 for r in out)
    assert identify(empty, model).collect() == []
    assert {r.lang_pred for r in identify(messy, fit([])).collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = op5(spark, d).collect()
    assert {r.doc_id for r in out} == langs.keys() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r.lang_pred == langs[r.doc_id] for r in out if r.held_out]
    assert sum(held) / len(held) > 0.98
