import zlib

import pytest

from tidemill.llm.toxicity import Distance, fit, labelled_sample, op8, score, stage

BASE = "the quick river runs along green hills while many people walk slowly under warm evening light near old stone houses".split()


def text(i, bad=False):
    w = [BASE[(i * 7 + j * (3 + i % 5)) % len(BASE)] for j in range(40)]
    return " ".join(w[:20] + (["scumbag", "vermin"] if bad else []) + w[20:])


@pytest.fixture(scope="module")
def model():
    return fit([(text(i) + f" a{i}", 0) for i in range(120)] + [(text(i, True) + f" b{i}", 1) for i in range(60)])


def test_windows_of_toxic_texts_are_told_apart(model):
    d = Distance(model)
    assert d.score(text(999)) < 0.5 <= d.score(text(999, True))
    assert d.of("scumbag") > 0 and max(d.of(w) for w in BASE) <= 0


def test_words_much_rarer_than_the_strongest_are_learned():
    common, rare = ((lambda i, w=w: f"{text(i)} {w} c{i}") for w in ("scumbag", "vermin"))
    d = Distance(fit([(text(i) + f" a{i}", 0) for i in range(800)] + [(common(i), 1) for i in range(360)] + [(rare(i), 1) for i in range(360, 400)]))
    assert d.score(common(999)) >= 0.5 and d.score(rare(999)) >= 0.5 and d.score(text(999)) < 0.5


def test_beginnings_that_toxic_words_share_are_learned():
    """Each toxic word is seen once at most in training, the ones scored never; only their beginning recurs."""
    ending = lambda i: "".join("aeioulnrst"[i // 10**k % 10] for k in range(4))
    bad = lambda i: f"{text(i)} vexqu{ending(i)} vexqu{ending(i + 5_000)}"
    good = lambda i: f"{text(i)} {ending(i)} {ending(i + 5_000)}"
    d = Distance(fit([(good(i), 0) for i in range(400)] + [(bad(i), 1) for i in range(400, 600)]))
    assert sum(d.score(bad(i)) >= 0.5 for i in range(700, 800)) > 90 and sum(d.score(good(i)) < 0.5 for i in range(800, 900)) > 95


def test_scores_of_messy_rows(spark, messy, empty, model):
    docs = messy.select("doc_id", "text", "node")
    out = score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.score for r in out if not r.text} == {model.share}
    assert score(empty.select("doc_id", "text"), model).collect() == []
    with pytest.raises(ValueError):
        score(messy, model)


def test_without_labels():
    assert Distance(fit([])).score("a b") == 0 and {Distance(fit([("a b", 1), ("c", 1)])).score(t) for t in ("a b", "", None, "d e f")} == {1.0}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = op8(spark, d).collect()
    assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    right = sum(p == y for p, y in held) / len(held)
    assert right > max(0.93, sum(1 - y for _, y in held) / len(held))


def test_held_out_recall_and_specificity(spark):
    """By language, where the sample holds enough toxic texts (some 220 English ones) to learn from."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = op8(spark, d).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "toxic").agg({"predicted": "avg", "*": "count"}).collect()
    share = {(r.lang, r.toxic): r["avg(predicted)"] for r in rows}
    assert share["en", 1] > 0.8
    assert all(share[lang, 0] < 0.03 for lang in ("en", "de", "fr", "es"))


def test_sample_is_broadcast(spark, small):
    """The texts of documents are not shuffled to meet the labels."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    texts, sizes = labelled_sample(docs, labels)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and sum(sizes.values()) == labels.filter("toxic in (0, 1)").count()


def test_stage_keeps_columns(spark, messy, empty, small):
    assert stage(spark, messy, small).columns == messy.columns
    assert stage(spark, empty, small).count() == 0


def test_windows_are_looked_up_and_not_compressed(model, monkeypatch):
    """Scoring needs no compressor, whatever its words; what no dictionary holds weighs as nothing."""
    from tidemill.llm import toxicity

    monkeypatch.setattr(toxicity, "zstandard", None)
    d = Distance(model)
    assert d.score(text(999)) < 0.5 <= d.score(text(999, True)) and d.beginning("scumbagged") == "scumbag" and d.of("0") == 0
    assert len(model.distances) < 40_000 and all(len(b) <= 65 for b in model.distances)
