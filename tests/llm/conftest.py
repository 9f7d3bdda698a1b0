import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, bin int"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, repeated rows, shared ids, and extra columns named as operators name theirs."""
    long = " ".join(f"word{i % 977} other{i % 31}." for i in range(30_000))
    rows = [
        (1, "Plain words of a short text, nothing more to see here at all.", "en"), (2, "Plain words of a short text, nothing more to see here at all.", "en"), (3, None, "en"), (4, "", None), (5, " \t\n ", "fr"),
        (6, long, "en"), (7, long + " tail", "en"), (8, "same words again " * 40, None), (8, "same words again " * 40, None), (8, "another text under the same id, which is long enough for shingles", "en"),
        (None, "A text without an id. A text without an id.", "en"), (None, None, None), (9, "one", "de"), (10, "日本語 Ελληνικά русский \U0001f600 \x85   x", None), (11, "one", None),
    ]
    return spark.createDataFrame([(i, t, lang, "src", len(t or ""), 0.5, 7, 1) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
