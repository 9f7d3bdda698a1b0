"""Toxicity by compression distance.

zstandard dictionaries are trained on a labelled sample: one on the words of toxic texts, and ordinary ones of rising sizes
on the words of ordinary texts, whole texts of both and no choice among their words. A window is cut behind its last letter that one of
them holds and compressed with each; the whole letters (of eight bytes) that the toxic dictionary saves against an ordinary one are its distances (none: 0, as ordinary
words do not make up for toxic ones). For the calibration the sample is cut into
FOLDS parts by a hash of the text, and each part is measured by dictionaries trained on the others: for each distance the
logarithm of how much more often windows of toxic texts have it, made to rise with the distance, and, for the sum of these over a text's windows by the root
of their number, the share of toxic texts (isotonic regression, weighted to the shares of the labels). That share is the score.

A window is one word (lower case, letters only, at most LONGEST; longer ones are several). Letter by letter it is spelled
as eight bytes, a hash of the word up to there, since zstandard stores what is as short as a word uncompressed, a match costs
it more than the few letters that it replaces, and only pieces that begin alike are then matches. A training sample is a
text's distinct words, so that the trainer ranks beginnings by the number of texts that have them. Dictionaries are small
on purpose: what is frequent in toxic texts is in the toxic one, and in an ordinary one only if it is frequent there too.
One size would decide this at one frequency; several let the calibration weigh them. As only beginnings that the dictionaries hold
matter, some 30,000 of them at most, each is compressed once, by the task that trains the dictionaries; a window is then looked up by its longest
beginning among them.

Bounds: the sample has about `sample` texts per label (chosen by a hash of doc_id), and all their windows count. One task
trains one of the FOLDS + 1 models and holds the sample's spelled words, some fifteen times its texts. Scores cover all windows of whole
texts of all rows; a text is held as the list of its words, so that a task needs some twenty times its longest text. Null and
empty texts, and texts without letters, get the share of toxic labels. Equal texts get equal scores; in the sample they count
once per label. Labels other than 0 and 1, and labels of no document, are ignored; a document with several labels counts once
for each. Without any toxic (or ordinary) labelled text every score is the share of toxic labels (0 without labels). Extra
columns are ignored; a column named as one that is added raises ValueError. An empty table of documents gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import crc_long, lean_memory, ship, slices, store

LONGEST = 64  # letters of a window
WINDOW = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
FOLDS = 3
TOXIC_SIZE, ORDINARY_SIZES = 65_536, (65_536, 131_072)
LETTER = 8  # bytes
FARTHEST = LONGEST + 2  # letters; no distance of a window is larger
LIKE_NONE = 1  # windows, half of each label, that are added to those of each distance
OTHER = xxhash.xxh64().digest()  # the letter behind a beginning, which no dictionary holds


def spelled(beginning: str) -> bytes:
    """The bytes that are compressed for a beginning; that of a whole window ends with a space."""
    so_far, out = xxhash.xxh64(), []
    for letter in beginning:
        so_far.update(letter.encode())
        out.append(so_far.digest())
    return b"".join(out)


def windows(text: str | None) -> list[str]:
    return WINDOW.findall(text.lower()) if text else []


def train_dictionary(texts: list[list[bytes]], size: int) -> bytes:
    """A dictionary trained on the windows of texts; where there is too little to train on, the windows themselves."""
    size = min(size, max(256, sum(len(w) for t in texts for w in t) // 4))
    for samples in (lambda: [b"".join(t) for t in texts], lambda: [w for t in texts for w in t]):
        try:
            return zstandard.train_dictionary(size, samples(), k=64, d=8).as_bytes()
        except zstandard.ZstdError:
            continue
    return b"".join(dict.fromkeys(w for t in texts for w in t))


@dataclass(frozen=True)
class Model:
    share: float
    distances: dict[str, tuple[int, ...]]  # of beginnings: letters saved against each ordinary dictionary; "" for all others. Empty: no model
    weights: tuple[float, ...] = ()  # for each ordinary dictionary, of distances from 0 to FARTHEST
    sums: tuple[float, ...] = ()  # rising; scores at them, and between them by interpolation
    scores: tuple[float, ...] = ()


def _compressor(dictionary: bytes):
    # the longest match at each place, from trees over all of the dictionary; no header
    rule = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=14, chain_log=16, search_log=5, min_match=5, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0,
    )
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(compression_params=rule)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=rule).compress


def saved(toxic: bytes, ordinary: list[bytes], known: list[str]) -> np.ndarray:
    """Whole letters saved on beginnings (rows) for each ordinary dictionary; one dictionary after the other, as each fills a core's cache."""
    data = [spelled(b) + (b"" if b.endswith(" ") else OTHER) for b in known]
    sizes = []
    for dictionary in (toxic, *ordinary):
        compress = _compressor(dictionary)
        sizes.append([len(compress(d)) for d in data])
    first, *others = np.array(sizes)
    return np.trunc((np.stack(others, 1) - first[:, None]) / LETTER).astype(int)


def beginnings(dictionaries: list[bytes], words: dict[str, bytes]) -> list[str]:
    """Beginnings of words whose last letter is in one of the dictionaries, and the empty one. words: with their spelling."""
    held = {d[i : i + LETTER] for d in dictionaries for i in range(len(d) - LETTER + 1)}
    return sorted({"", *(f"{w} "[: i + 1] for w, data in words.items() for i in range(len(w) + 1) if data[LETTER * i : LETTER * (i + 1)] in held)})


class Distance:
    """Distances and scores of texts; recent windows are remembered."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most, self.known = model, most, {}
        self.longest = max(map(len, model.distances), default=0)
        ordinary = len(next(iter(model.distances.values()), ()))
        self.size = (FARTHEST + 1) * ordinary
        places = np.maximum(np.array(list(model.distances.values()), int).reshape(len(model.distances), ordinary), 0) + (FARTHEST + 1) * np.arange(ordinary)
        made = np.array(model.weights)[places].sum(1) if model.weights else places
        self.made = dict(zip(model.distances, made.tolist(), strict=True))

    def beginning(self, window: str) -> str:
        """The longest beginning of a window that the model knows."""
        whole = f"{window} "
        for n in range(min(len(whole), self.longest), 0, -1):
            if whole[:n] in self.made:
                return whole[:n]
        return ""

    def of(self, window: str) -> int:
        """Letters saved against the best ordinary dictionary."""
        return min(self.model.distances[self.beginning(window)])

    def _remembered(self, found: Counter) -> dict:
        """Of windows: their weight (calibrated), or the places of their distances in Model.weights (before)."""
        if len(self.known) > self.most:
            self.known.clear()
        for w in found:
            if w not in self.known:
                self.known[w] = self.made[self.beginning(w)]
        return self.known

    def counts(self, text: str | None) -> list[int]:
        """How many windows of the text have each distance, in the order of Model.weights, for a model without them."""
        out = [0] * self.size
        found = Counter(windows(text))
        known = self._remembered(found)
        for w, n in found.items():
            for place in known[w]:
                out[place] += n
        return out

    def score(self, text: str | None) -> float:
        found = Counter(windows(text)) if self.model.weights else None
        if not found:
            return self.model.share
        known = self._remembered(found)
        x = sum([n * known[w] for w, n in found.items()]) / (found.total() + 1) ** 0.5
        # the last thousandth keeps the order where the calibration is flat
        return float(0.999 * np.interp(x, self.model.sums, self.model.scores) + 0.0005 * (1 + x / (1 + abs(x))))


def distances(texts: list[tuple[int, str]]) -> dict[str, tuple[int, ...]]:
    """Model.distances from (label, text); empty if a label has no windows."""
    words: dict[str, bytes] = {}  # each spelled once

    def of_text(text: str) -> list[bytes]:
        found = dict.fromkeys(windows(text))
        words.update((w, spelled(f"{w} ")) for w in found if w not in words)
        return [words[w] for w in found]

    train: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for y, text in texts:
        if found := of_text(text):
            train[y].append(found)
    if not train[0] or not train[1]:
        return {}
    toxic, ordinary = train_dictionary(train[1], TOXIC_SIZE), [train_dictionary(train[0], size) for size in ORDINARY_SIZES]
    train.clear()
    known = beginnings([toxic, *ordinary], words)
    return dict(zip(known, map(tuple, saved(toxic, ordinary, known).tolist()), strict=True))


def calibrated(model: Model, counts: list[list[int]], labels: list[int]) -> Model:
    """counts: for each text what Distance.counts gives with dictionaries trained without it; labels: 0 or 1."""
    y = np.array(labels, int)
    if not model.distances or not y.any() or y.all():
        return Model(model.share, {})
    counts = np.array(counts, float)
    ordinary = counts.shape[1] // (FARTHEST + 1)
    tails = [counts[y == label].sum(0).reshape(ordinary, -1) for label in (0, 1)]
    weights = np.concatenate([rising(t0, t1) for t0, t1 in zip(*tails, strict=True)])
    w = np.where(y == 1, model.share / y.mean(), (1 - model.share) / (1 - y.mean()))
    windows_of = counts.sum(1) / ordinary
    sums, scores = isotonic(counts @ weights / np.sqrt(windows_of + 1), y, w)
    return Model(model.share, model.distances, tuple(weights.tolist()), tuple(sums.tolist()), tuple(scores.tolist()))


def rising(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """From the windows that have each distance: how much more often those of toxic texts have it (logarithm), never falling with it."""
    places, seen = np.arange(len(toxic)), np.flatnonzero(ordinary + toxic)
    shares = [(n[seen] + LIKE_NONE / 2) / n.sum() if n.sum() else np.ones(len(seen)) for n in (toxic, ordinary)]
    x, share = isotonic(np.tile(seen, 2), np.repeat([1, 0], len(seen)), np.concatenate(shares))
    return np.interp(places, x, np.log(share) - np.log1p(-share))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising shares of y by x: both ends of each block of pooled neighbours, and the share of its ones at both."""
    blocks: list[list[float]] = []  # weight of ones, weight, first x, last x
    for i in np.lexsort((-y, x)):
        blocks.append([w[i] * y[i], w[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            ones, weight, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + ones, blocks[-1][1] + weight, blocks[-1][2], last]
    b = np.array(blocks)
    return b[:, 2:].ravel(), np.repeat(b[:, 0] / b[:, 1], 2)


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def fit(labelled: list[tuple[str, int]]) -> Model:
    """From (text, 0 or 1) in memory; equal texts with equal labels count once."""
    labelled = sorted(set(labelled))
    share = float(np.mean([y for _, y in labelled])) if labelled else 0.0
    folds = [hash_of(t) % FOLDS for t, _ in labelled]
    *of_folds, model = [Model(share, distances([(y, t) for f, (t, y) in zip(folds, labelled, strict=True) if f != k])) for k in range(FOLDS + 1)]
    if not all(m.distances for m in (*of_folds, model)):
        return Model(share, {})
    measures = [Distance(m) for m in of_folds]
    return calibrated(model, [measures[f].counts(t) for f, (t, _) in zip(folds, labelled, strict=True)], [y for _, y in labelled])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = 3_000) -> tuple[DataFrame, dict[int, int]]:
    """text, y of about `sample` texts of each label (all where there are fewer), and the number of labels of each."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    rule = F.lit(False)
    for y, n in sizes.items():
        rule |= (F.col("y") == y) & (F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)
    few = F.broadcast(known.filter(rule))  # two labels, about `sample` rows of 12 bytes each
    texts = docs.select("doc_id", "text").filter("text is not null").join(few, "doc_id").select("text", "y")
    return texts, sizes


def trained(docs: DataFrame, labels: DataFrame, sample: int = 3_000) -> Model:
    """The model of the labelled rows of docs. What comes to the driver are beginnings with their distances, and counts of distances of about `sample`
    texts per label for the calibration."""
    ship(docs.sparkSession)
    texts, sizes = labelled_sample(docs, labels, sample)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    texts = store(texts.dropDuplicates(["text", "y"]).select("text", "y", crc_long(F.col("text")).alias("text_hash")), "labelled")

    def train(key, table):
        lean_memory()
        rows = sorted(zip(table.column("text_hash").to_pylist(), table.column("text").to_pylist(), table.column("y").to_pylist(), strict=True))
        found = distances([(y, t) for _, t, y in rows])
        made = {"model": pa.array([key[0].as_py()] * len(found), pa.int32()), "beginning": pa.array(list(found), pa.string())}
        return pa.table(made | {"distances": pa.array(list(found.values()), pa.list_(pa.int32()))})

    others = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda k: k != F.col("text_hash") % FOLDS)
    made = texts.select("text", "y", "text_hash", F.explode(others).alias("model")).groupBy("model").applyInArrow(train, "model int, beginning string, distances array<int>")
    of_models: dict[int, dict[str, tuple[int, ...]]] = {}
    for batch in made.toArrow().to_batches(max_chunksize=2_000):  # some 30,000 short rows for each model
        for k, beginning, found in zip(*(batch.column(c).to_pylist() for c in ("model", "beginning", "distances")), strict=True):
            of_models.setdefault(k, {})[beginning] = tuple(found)
    if len(of_models) <= FOLDS:
        return Model(share, {})
    known = {k: Model(share, found) for k, found in of_models.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = [Distance(known[k]) for k in range(FOLDS)]
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = part.column("text_hash")
                found = [measures[h % FOLDS].counts(t) for t, h in zip(part.column("text").to_pylist(), hashes.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([hashes, part.column("y"), pa.array(found, pa.list_(pa.int64()))], ["text_hash", "y", "counts"])

    spread = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism)  # a small table is one file
    t = spread.mapInArrow(count, "text_hash long, y int, counts array<long>").orderBy("text_hash", "y").toArrow()
    return calibrated(known[FOLDS], t.column("counts").to_pylist(), t.column("y").to_pylist())


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score and a predicted label added, under names that docs has not."""
    if set(names) & set(docs.columns):
        raise ValueError(f"docs has a column of {names}")
    ship(docs.sparkSession)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model)
        for batch in batches:
            for part in slices(batch, "text"):
                s = np.array([distance.score(t) for t in part.column("text").to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*columns, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def _trained(docs: DataFrame, labels: DataFrame) -> Model:
    """From labels of documents whose crc32(doc_id as text) mod 5 is not 0."""
    return trained(docs, labels.filter(held_out_rule(F.col("doc_id")) != 0))


def held_out_rule(doc_id):
    return F.pmod(crc_long(doc_id.cast("string")), F.lit(5))


def op8(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), _trained(docs, labels))
    return out.select("doc_id", F.coalesce(held_out_rule(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is 0, with the columns of documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any name that docs has
    scored = score(docs, _trained(docs, labels), (f"{own}score", f"{own}predicted"))
    return scored.filter(F.col(f"{own}predicted") == 0).select(docs.columns)
