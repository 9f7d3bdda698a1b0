import __spark_entry__
import corpus_pipeline
from tidemill.llm import queries
from tidemill.llm.decontaminate import contaminated
from tidemill.llm.packing import default_tokenizer, pack
from tidemill.llm.pseudonyms import DEMO_KEY, pseudonymise
from tidemill.llm.toxicity import _trained, score

from tests.llm.test_ngram_join import brute


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and queries.queries().keys() <= names.keys() and len(corpus_pipeline.STAGES) == 5


def test_stages_against_plain_steps(spark, small):
    """Decisions of each stage from its operator or brute force, on plain rows; then the pieces."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {r.doc_id: r.text for r in score(docs.select("doc_id", "text"), _trained(docs, labels)).filter("predicted = 0").collect()}
    first = {d for d, (c, _) in brute(list(kept.items())).items() if c == d}
    left = docs.filter(docs.doc_id.isin(sorted(first)))
    bad = {r.doc_id for r in contaminated(left, bench).collect()}
    left = pseudonymise(left.filter(~left.doc_id.isin(sorted(bad))), DEMO_KEY)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert bad and len(first) < len(kept)
    assert key(corpus_pipeline.run(spark, small)) == key(pack(left, default_tokenizer()))


def test_messy_rows(spark, messy, empty, small):
    for docs in (messy, empty):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == messy.columns
        assert docs.count() <= n
        corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
