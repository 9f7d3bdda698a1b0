"""Language of mixed texts: scripts narrow the candidates, Viterbi over per-word scores labels spans.

A word is a maximal run of letters, in lower case. Its score for a language is the sum, over its character n-grams (1
to 4, with word ends), of log P(n-gram | language) from add-one counts, each divided by the n-grams' overlap of 4. The
script of a word is that of its first letter (Unicode blocks, see SCRIPTS); languages that the sample never writes in
that script are out for the word, unless that rules out all.

Viterbi finds the best sequence of languages over the words of a text, where each change costs `penalty`. Runs of
equal labels are the spans. The text's language is the one with the most letters in its spans (ties: the first in
alphabetical order); the score is its share of the letters.

The classifier is fitted on at most about `sample` texts per language (chosen by a hash of doc_id), the one documented
bound; all rows' whole texts are labelled. Text that is null or has no letter gets `und` and score 0. Without any
labelled text every text gets `und`. Rows with equal doc_id are labelled on their own, equal texts alike.
Very long texts travel alone and are labelled whole; an empty table gives no rows. Up to 32,767 languages. Extra columns are
ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import crc_long, ship, slices
from tidemill.llm.text_arrays import mix

#: First code points of Unicode's script blocks (fixed values): letters from there on to the next one.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3400, "Han"),
    (0xA000, "Yi"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS = np.array([a for a, _ in SCRIPTS], np.uint32)
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int64)
GRAMS, BUCKETS = 4, 1 << 18
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x languages, log probabilities
    scripts: np.ndarray  # scripts x languages, which languages are candidates


class Letters:
    """Words (runs of letters) of several texts as arrays of code points."""

    def __init__(self, texts: list[str]):
        joined = " " + " ".join(texts) + " "
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letter_table()[self.codes]
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        at = np.cumsum([1] + [len(t) + 1 for t in texts])
        edge = np.searchsorted(self.starts, at)
        self.lo, self.hi = edge[:-1], edge[1:]
        self.inside = inside

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each n-gram and the word it is of, words in turn for each n."""
        codes = np.where(self.inside, self.codes, 32).astype(np.uint64)
        words = np.zeros(len(codes), np.int64)
        words[self.starts] = 1
        words = np.cumsum(words) - 1
        before = np.zeros(len(codes), bool)
        before[self.starts - 1] = True  # the space before a word belongs to it
        after = np.zeros(len(codes), bool)
        after[self.ends] = True
        buckets, owner = [], []
        value = np.zeros(len(codes), np.uint64)
        open_ = self.inside | before
        for n in range(1, GRAMS + 1):
            if n > 1:
                # a longer n-gram goes on only while it has not passed the space after its word
                open_ = open_[:-1] & (self.inside | after)[n - 1 :]
                if n > 2:
                    open_ &= self.inside[n - 2 : len(codes) - 1]
                else:
                    open_ &= self.inside[n - 1 :] | self.inside[: -(n - 1)]
            value = value[: len(open_)] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
            at = np.flatnonzero(open_ if n > 1 else self.inside)
            buckets.append((mix(value[at] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64))
            owner.append(words[at] + before[at])
        return buckets, owner

    def scripts(self) -> np.ndarray:
        return _SCRIPT[np.searchsorted(_STARTS, self.codes[self.starts], "right") - 1]


def fit(labelled: list[tuple[str, str]]) -> Model:
    """labelled: (text, language)."""
    labelled = sorted(set(labelled))
    languages = tuple(sorted({lang for _, lang in labelled}))
    counts = np.ones((BUCKETS, len(languages)))
    scripts = np.zeros((len(_NAMES), len(languages)))
    for j, lang in enumerate(languages):
        texts = [t.lower() for t, y in labelled if y == lang]
        for i in range(0, len(texts), 200):
            letters = Letters(texts[i : i + 200])
            for b in letters.grams()[0]:
                counts[:, j] += np.bincount(b, minlength=BUCKETS)
            scripts[:, j] += np.bincount(letters.scripts(), minlength=len(_NAMES))
    weights = (np.log(counts) - np.log(counts.sum(0))).astype(np.float32) / GRAMS
    allowed = scripts > 0
    allowed[~allowed.any(1)] = True
    return Model(languages, weights, allowed)


def word_scores(letters: Letters, model: Model) -> np.ndarray:
    out = np.zeros((len(letters.starts), len(model.languages)), np.float32)
    if not len(out):
        return out
    for b, w in zip(*letters.grams(), strict=True):
        if not len(w):
            continue
        begin = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        out[w[begin]] += np.add.reduceat(model.weights[b], begin, axis=0)
    out[~model.scripts[letters.scripts()]] = -np.inf
    return out


def viterbi(scores: np.ndarray, lo: np.ndarray, hi: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; rows are texts, all advanced together."""
    n = hi - lo
    order = np.argsort(-n, kind="stable")
    lo, n = lo[order], n[order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more than t words
    came = np.full(scores.shape, -1, np.int16)  # label before, where it is another
    best = np.zeros((len(n), scores.shape[1]), np.float32)
    for t in range(longest):
        k = active[t]
        now = best[:k]
        at = lo[:k] + t
        if t:
            top = now.argmax(1)
            jump = now[np.arange(k), top] - np.float32(penalty)
            change = jump[:, None] > now
            came[at] = np.where(change, top[:, None].astype(np.int16), -1)
            now = np.where(change, jump[:, None], now)
        best[:k] = now + scores[at]
    labels = np.zeros(len(scores), np.int16)
    label = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = lo[:k] + t
        labels[at] = label[:k]
        before = came[at, label[:k]]
        label[:k] = np.where(before >= 0, before, label[:k])
    return labels


def label_words(texts: list[str], model: Model, penalty: float) -> tuple[list[Letters], list[np.ndarray]]:
    """Letters and word labels, for groups of texts in turn."""
    groups, scores, size, part = [], [], 0, []
    for text in [*texts, None]:
        if text is None or size > 500_000:
            if part:
                groups.append(Letters(part))
                scores.append(word_scores(groups[-1], model))
            part, size = [], 0
        if text is not None:
            part.append(text)
            size += len(text)
    lo = np.concatenate([g.lo + d for g, d in zip(groups, np.cumsum([0] + [len(s) for s in scores]), strict=False)] or [np.zeros(0, np.int64)])
    hi = np.concatenate([g.hi + d for g, d in zip(groups, np.cumsum([0] + [len(s) for s in scores]), strict=False)] or [np.zeros(0, np.int64)])
    labels = viterbi(np.concatenate(scores), lo, hi, penalty) if groups else np.zeros(0, np.int16)
    return groups, np.split(labels, np.cumsum([len(s) for s in scores])[:-1]) if groups else []


_SPANS = "array<struct<lang:string,first_word:int,words:int,letters:int>>"


def identify(docs: DataFrame, model: Model, penalty: float = 6.0, with_spans: bool = True) -> DataFrame:
    """Per row: doc_id, lang_pred, score, spans (language, first word, words, letters)."""
    ship(docs.sparkSession)
    names = np.array(model.languages, object)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32()), ("letters", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 6_000_000):
                texts = pc.utf8_lower(part.column("text")).fill_null("").to_pylist()
                langs, scores, spans = [], [], []
                if not len(names):
                    langs, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts)
                for letters, labels in zip(*label_words(texts, model, penalty), strict=True) if len(names) else ():
                    size = letters.ends - letters.starts
                    row = np.repeat(np.arange(len(letters.lo)), letters.hi - letters.lo)
                    share = np.bincount(row * len(names) + labels, size, len(letters.lo) * len(names)).reshape(-1, len(names))
                    total = share.sum(1)
                    top = share.argmax(1)
                    langs += ["und" if not n else names[j] for n, j in zip(total, top, strict=True)]
                    scores += (share[np.arange(len(top)), top] / np.maximum(total, 1)).tolist()
                    if with_spans:
                        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (labels[1:] != labels[:-1]))) if len(row) else np.zeros(0, np.int64)
                        ends = np.append(new[1:], len(row)) if len(new) else new
                        run_letters = np.add.reduceat(size, new) if len(new) else size
                        own: list[list] = [[] for _ in letters.lo]
                        for a, b, r, j, n in zip(new.tolist(), ends.tolist(), row[new].tolist(), labels[new].tolist(), run_letters.tolist(), strict=True):
                            own[r].append({"lang": names[j], "first_word": a - int(letters.lo[r]), "words": b - a, "letters": n})
                        spans += own
                arrays = [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, kind)] if with_spans else arrays, ["doc_id", "lang_pred", "score", "spans"][: 3 + with_spans])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double" + (f", spans {_SPANS}" if with_spans else ""))


def labelled_sample(docs: DataFrame, sample: int = 1_000) -> list[tuple[str, str]]:
    """At most about `sample` texts per language; all where there are fewer."""
    known = docs.filter("lang is not null and text is not null")
    counts = known.groupBy("lang").count()
    few = known.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64("doc_id", "lang"), F.col("count")) < sample)
    return [(r.text, r.lang) for r in few.select("text", "lang").collect()]


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.pmod(crc_long(F.col("doc_id").cast("string")), F.lit(4))
    model = fit(labelled_sample(docs.filter(remainder != 2)))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
