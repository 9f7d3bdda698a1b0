"""Packing of token pieces into fixed windows by non-negative least squares over length combinations.

1. Each text is tokenised, the closing id is added, and the ids are cut into pieces of `window` ids and one rest.
2. Rests are put into bins by length and counted: exact ones up to `fine` ids, above that of `grain` ids (rounded up). A
   bin's number is the room that its pieces take.
3. Combinations of bins that fill a window exactly are enumerated: all of up to three bins, and for bins of up to a
   quarter of the window those of nearly as many of their pieces as fit and up to two others. Non-negative least squares
   finds repeat counts whose bins match the histogram; they are rounded down and cut back to what there is.
4. Pieces that this leaves over are packed greedily (longest first, then the longest that still fits), on the
   histogram, which adds a few combinations with repeat counts.
5. Pieces are numbered within their bin (count per bin and hash part, offsets, then numbers within a part: no task
   gets a whole bin), and the number says to which repeat of which combination a piece goes.

Only the histogram (fine + window / grain counts) and the bin-part counts (times `parts`) reach the driver. The plan depends
on counts alone, so a lost executor's rows come out the same again.

A null text counts as empty: its only id is the closing one. Rows with equal doc_id are separate documents here,
as are repeated rows. A very long text is encoded by stretches, in the task of its row. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import ship, slices, store

#: Texts of these characters are cut into words here as the tokenizer would; others go to the tokenizer whole. Left
#: out: numbers other than digits, white space that only one of the two knows, and what may combine or be special.
_OTHER = re.compile(r"[^\t\n\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af]")
#: The tokenizer's own rule for words (a fixed value), in lower case.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts, word by word where that gives the same, with the ids of recent words and of recent stretches
    between white space kept."""

    def __init__(self, path: str, most: int = 200_000, most_stretches: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_stretches, self.known, self.stretches = Tokenizer.from_file(path), most, most_stretches or 5 * most // 2, {}, {}

    def learn(self, words: set[str], at_once: int = 1_000) -> None:
        """Ids of new words: many in one text, told apart by the tokenizer's word numbers."""
        new = list(words)
        for lo in range(0, len(new), at_once):
            part = new[lo : lo + at_once]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            of = np.array([-1 if k is None else k for k in e.word_ids])
            cut = np.searchsorted(of, np.arange(len(part) + 1))
            if len(of) and (np.diff(of) >= 0).all() and of[0] == 0 and of[-1] == len(part) - 1 and (np.diff(cut) > 0).all():
                ids, cut = np.array(e.ids, "<u4").tobytes(), (4 * cut).tolist()
                self.known.update((w, ids[a:b]) for w, a, b in zip(part, cut[:-1], cut[1:], strict=True))
                continue
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[word] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    @staticmethod
    def words(stretch: str) -> list[str] | tuple[str, ...]:
        """The tokenizer's words of lower-case text without white space; most are a word with or without a mark."""
        if stretch.isalpha():
            return (stretch,)
        if stretch[:-1].isalpha() and not stretch[-1].isalnum():
            return (stretch[:-1], stretch[-1])
        return _WORDS.findall(stretch)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        split = {i: t.lower().split() for i, t in enumerate(texts) if "<|" not in t and not _OTHER.search(t)}
        whole = [i for i in range(len(texts)) if i not in split]
        needed = set().union(*split.values())
        fresh = needed.difference(self.stretches)
        if len(self.stretches) + len(fresh) > self.most_stretches:
            self.stretches.clear()
            fresh = needed
        pieces = {c: self.words(c) for c in fresh}
        words = set().union(*pieces.values())
        if len(needed) > self.most_stretches or len(words) > self.most:
            whole, split = whole + list(split), {}
        elif words:
            missing = words.difference(self.known)
            if len(self.known) + len(missing) > self.most:
                self.known.clear()
                missing = words
            self.learn(missing)
            self.stretches.update((c, b"".join([self.known[w] for w in ws])) for c, ws in pieces.items())
        for i, stretches in split.items():
            out[i] = b"".join(map(self.stretches.__getitem__, stretches))
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows, start, length, crc, total = [], [], [], [], []
                for r, ids in enumerate(enc.encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += last
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        piece = ids[4 * at : 4 * (at + window)]
                        rows.append(r)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                at_rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at_rows), part.column("text_key").take(at_rows), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def nnls(columns: np.ndarray, weight: np.ndarray, goal: np.ndarray, most: int = 2000, times: np.ndarray | None = None) -> np.ndarray:
    """Least squares a x = goal with x >= 0, by active sets: columns enter one at a time by the steepest slope, and leave
    where the unconstrained solution of the active ones would turn them negative. The matrix is given by its few
    entries: column j has weight[r] for each r in columns[j] (rows may repeat; row 0 stands for none, weight 0), times
    as often as `times` says."""
    n = len(columns)
    times = np.ones(columns.shape) if times is None else times
    x, active = np.zeros(n), np.zeros(n, bool)
    slope_of = lambda v: ((weight * v)[columns] * times).sum(1)
    tiny = 1e-9 * max(1.0, float(np.abs(slope_of(goal)).max(initial=0)))
    on = np.zeros(0, np.int64)  # active columns, with their products with each other and with goal
    dense, gram, right = np.zeros((len(weight), 0)), np.zeros((0, 0)), np.zeros(0)
    for _ in range(most):
        residual = goal - weight * np.bincount(columns.ravel(), (x[:, None] * times).ravel(), len(weight))
        slope = np.where(active, -np.inf, slope_of(residual))
        j = int(np.argmax(slope)) if n else 0
        if not n or slope[j] <= tiny:
            break
        active[j] = True
        column = np.bincount(columns[j], weight[columns[j]] * times[j], len(weight))
        few = np.flatnonzero(column)
        cross = column[few] @ dense[few]
        own = float(column @ column)
        gram = np.block([[gram, cross[:, None]], [cross[None], np.array([[own + 1e-12 * (1 + own)]])]])  # active columns may depend on each other
        dense, right, on = np.column_stack([dense, column]), np.append(right, column @ goal), np.append(on, j)
        while len(on):
            z = np.linalg.solve(gram, right)
            if (z > tiny).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= tiny
            step = (x[on][low] / np.maximum(x[on][low] - z[low], 1e-300)).min()
            x[on] += step * (z - x[on])
            gone = x[on] <= tiny if (x[on] <= tiny).any() else low
            x[on[gone]] = 0
            active[on[gone]] = False
            dense, gram, right, on = dense[:, ~gone], gram[np.ix_(~gone, ~gone)], right[~gone], on[~gone]
    return x


def combinations(has: np.ndarray, pairs: int = 8) -> list[tuple[tuple[int, int], ...]]:
    """(bin, times) of combinations that sum to the window, of bins b with has[b] (1 .. window): all of two or three
    pieces, and those of many pieces of one bin with at most two others (up to `pairs` choices of two)."""
    window = len(has) - 1
    sizes = np.flatnonzero(has[:window])
    out: list[tuple[tuple[int, int], ...]] = []
    for a in sizes.tolist():
        if 2 * a <= window and has[window - a]:
            out.append(((a, 1), (window - a, 1)))
        b = sizes[(sizes >= a) & (2 * sizes <= window - a)]
        out += [((a, 1), (m, 1), (window - a - m, 1)) for m in b[has[window - a - b]].tolist()]
    for a in sizes[4 * sizes <= window].tolist():
        for k in range(max(4, window // a - 3), window // a + 1):
            rest = window - k * a
            if rest == 0 or has[rest]:
                out.append(((a, k), (rest, 1)) if rest else ((a, k),))
            b = sizes[2 * sizes <= rest]
            out += [((a, k), (m, 1), (rest - m, 1)) for m in b[has[rest - b]][-pairs:].tolist()]
    return out


def least_squares(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with repeat counts that fill windows exactly; what they use is taken off left."""
    combos = combinations(left > 0)
    if not combos:
        return []
    out = []
    rows = np.flatnonzero(left)
    at = np.zeros(len(left), np.int64)
    at[rows] = np.arange(1, len(rows) + 1)
    padded = np.array([(*c, (0, 0), (0, 0))[:3] for c in combos])
    columns, times = at[padded[:, :, 0]], padded[:, :, 1].astype(np.float64)
    weight = np.append(0, 1 / np.sqrt(left[rows]))  # a piece missed in a rare bin weighs more than in a common one
    x = nnls(columns, weight, np.append(0, left[rows]) * weight, times=times)
    for j in np.argsort(-x, kind="stable")[: np.count_nonzero(x > 0)]:
        combo = tuple(sorted(b for b, k in combos[j] for _ in range(k)))
        need = np.bincount(combo, minlength=len(left))
        n = min(int(x[j] + 1e-6), *(int(left[b] // need[b]) for b in combo))
        if n > 0:
            left -= n * need
            out.append((combo, n))
    return out


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """histogram[b]: pieces of bin b (b = 1 .. bins). Combinations of bins with repeat counts that use each piece once."""
    bins = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[bins]:
        out.append(((bins,), int(left[bins])))
        left[bins] = 0
    out += least_squares(left)
    while left.any():
        take, room = [], bins
        spare = left.copy()
        while room > 0 and (fit := np.flatnonzero(spare[: room + 1])).size:
            b = int(fit[-1])
            k = min(int(spare[b]), room // b)
            take += [b] * k
            spare[b] -= k
            room -= k * b
        need = np.bincount(take, minlength=bins + 1)
        n = max(1, min(int(left[b] // need[b]) for b in set(take)))
        left -= n * need
        out.append((tuple(sorted(take)), n))
    return out


def _assign(bins_plan: list[tuple[tuple[int, ...], int]]):
    """Per bin: rising bounds of piece numbers, and what a number in each range means."""
    bounds: dict[int, list[int]] = {}
    means: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for combo, n in bins_plan:
        for slot, b in enumerate(combo):
            have = bounds.setdefault(b, [0])
            means.setdefault(b, []).append((first, slot, have[-1]))
            have.append(have[-1] + n)
        first += n
    bounds_of = {b: np.array(v[1:], np.int64) for b, v in bounds.items()}
    means_of = {b: np.array(v, np.int64) for b, v in means.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, number = batch.column("bin").to_numpy(), batch.column("number").to_numpy()
            out = np.zeros((len(b), 3), np.int64)
            for x in np.unique(b):
                at = np.flatnonzero(b == x)
                out[at] = means_of[int(x)][np.searchsorted(bounds_of[int(x)], number[at], "right")]
            names = ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out[:, 0] + number - out[:, 2]), pa.array(out[:, 1])], [*names, "sequence_id", "slot"])

    return run


_PIECE = "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, grain: int = 16, parts: int = 256, fine: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    pieces = texts.mapInArrow(_pieces(tokenizer, end_id, window), _PIECE)
    room = F.when(F.col("length") <= fine, F.col("length")).otherwise(F.least(F.ceil(F.col("length") / grain) * grain, F.lit(window)))
    pieces = pieces.withColumn("bin", room.cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.lit(parts)).cast("int"))
    pieces = store(pieces, "pieces")
    counts = pieces.groupBy("bin", "part").count().orderBy("bin", "part").collect()  # at most (fine + window / grain) * parts rows
    histogram = np.zeros(window + 1, np.int64)
    offsets = []
    for r in counts:
        offsets.append((r.bin, r.part, int(histogram[r.bin])))
        histogram[r.bin] += r["count"]
    before = docs.sparkSession.createDataFrame(offsets, "bin int, part int, before long")
    order = W.partitionBy("bin", "part").orderBy("doc_id", "text_key", "start")
    numbered = pieces.withColumn("n", F.row_number().over(order)).join(before, ["bin", "part"])
    numbered = numbered.select("doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", "bin", (F.col("before") + F.col("n") - 1).alias("number"))
    placed = numbered.mapInArrow(_assign(plan(histogram)), f"{_PIECE}, sequence_id long, slot long")
    inside = W.partitionBy("sequence_id").orderBy("slot", "doc_id", "text_key", "start").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
