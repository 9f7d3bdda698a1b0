"""A training corpus from raw documents: each stage works on all that the one before it kept.

Toxic documents go, one row of each near-duplicate class stays, documents that hold benchmark items go, personal
numbers and dates become pseudonyms, and what is left is packed into token sequences. Rows with a null doc_id take part
in the near-duplicate stage by their texts; all stages keep the columns of documents but the last, which returns pieces.
"""

from __future__ import annotations

from tidemill.llm import decontaminate, ngram_join, packing, pseudonyms, toxicity
from tidemill.llm.common import store


def _near_duplicates(spark, docs, sf_dir):
    return ngram_join.one_of_each(docs)


def _packing(spark, docs, sf_dir):
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", toxicity.stage),
    ("n-gram Jaccard join", _near_duplicates),
    ("benchmark decontamination", decontaminate.stage),
    ("PII", pseudonyms.stage),
    ("packing", _packing),
]

#: Classifier, tokenizer and keyed hashes are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Pieces of the packed corpus; every stage's output is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = store(docs, f"stage-{k}")
    return docs
