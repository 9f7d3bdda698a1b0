"""Hard negatives by a BOND scan of vertical blocks.

The score of a row for an anchor is their inner product in integers. Rows are stored as blocks with one array per
dimension, sorted by label. An anchor reads a block's dimensions in the order of its own magnitudes, largest first, a few
at a time; after each the least and the most that the dimensions unread can still add (from the block's minimum and
maximum of each) bound every candidate's score, and candidates that cannot enter leave the bitmap. Those that have had all
dimensions read have their exact scores.

Two scans: the first finds the positives (the best rows of the anchor's label, a candidate needs to reach the last of the
best so far), the second the negatives (a candidate needs to reach a window of one of the positives, above the last of that window's best so far).

Anchors are the query set; each meets all rows, in blocks: anchors are dealt to chunks of about `chunk`, blocks to ranges
of at most `run` blocks, and a task takes one chunk through one range, block by block. It holds the chunk and one block and
returns the best of each anchor, which are merged by windows of a few rows per range. A block is sent once to each chunk.

Rows with a null id, a null label, or a vector that is null, empty or holds a null or non-finite component take no part.
Vectors of different lengths do not meet. Rows with equal ids are rows of their own: each such anchor has its own results,
and another row of the anchor's id may be its positive. Rows of equal score and id follow the order in which they are stored. An
anchor without positives, or a positive without negatives, gives no row. Scores are exact; beyond a long they count as its
largest or smallest value. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import lean_memory, ship, store
from tidemill.llm.whitening import by_length, matrix, sound

DEAL = ["length", "chunk", "range"]
LEAST, MOST = -(2**63), 2**63 - 1
_BLOCK = "block long, n int, rows binary, ids binary, labels binary, kind string, x binary"


def _blocks(block_rows: int, block_bytes: int = 4_000_000):
    """Rows (length, row, vec_id, label, v), sorted, as blocks of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for length, part in by_length(batch):
                step = max(1, min(block_rows, block_bytes // (8 * length)))
                for at in range(0, part.num_rows, step):
                    piece = part.slice(at, step)
                    x = np.ascontiguousarray(matrix(piece.column("v")).T)
                    kind = "<i2" if np.abs(x).max() < 2**15 else "<f8"
                    row, vec_id, label = (piece.column(c).to_numpy() for c in ("row", "vec_id", "label"))
                    values = [[length], [int(row[0])], [len(row)], [row.tobytes()], [vec_id.tobytes()], [label.tobytes()], [kind], [x.astype(kind).tobytes()]]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["length", "block", "n", "rows", "ids", "labels", "kind", "x"])

    return run


class Anchor:
    """One anchor, the order in which it reads dimensions, and the best found for each of its windows [low, high]."""

    def __init__(self, row: int, label: int, x: np.ndarray, lows: list[int], highs: list[int], most: int, same: bool):
        self.row, self.label, self.x, self.same, self.most = row, label, x, same, most
        self.order = np.argsort(-np.abs(x), kind="stable")
        self.lows, self.highs = lows, highs
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in lows]  # (-score, vec_id, row), sorted

    def floor(self, k: int) -> int:
        """What a score needs to enter window k."""
        return max(self.lows[k], -self.best[k][-1][0]) if len(self.best[k]) == self.most else self.lows[k]

    def scan(self, block: Block, step: int = 8) -> None:
        alive = np.flatnonzero((block.labels == self.label) & (block.rows != self.row) if self.same else block.labels != self.label)
        if not len(alive):
            return
        x, least, largest = (block.wide, block.wide_least, block.wide_largest) if block.needs_wide(self.x) else (block.x, block.least, block.largest)
        a = self.x if x.dtype != object else np.array([int(v) for v in self.x], object)
        low, high = np.minimum(a * least, a * largest)[self.order], np.maximum(a * least, a * largest)[self.order]
        windows = [(self.floor(k), self.highs[k]) for k in range(len(self.lows))]
        whole, score = len(alive) == block.n, np.zeros(len(alive), x.dtype)
        rest_low, rest_high = low.sum(), high.sum()
        for at in range(0, len(a) + step, step):
            keep = np.zeros(len(alive), bool)
            for floor, top in windows:
                keep |= (score + rest_high >= floor) & (score + rest_low <= top)
            if not keep.all():
                alive, score, whole = alive[keep], score[keep], False
            if not len(alive) or at >= len(a):
                break
            dims = self.order[at : at + step]
            score = score + a[dims] @ (x[dims] if whole else x[np.ix_(dims, alive)])
            # from what is left, so that the last bounds are exactly zero
            rest_low, rest_high = low[at + step :].sum(), high[at + step :].sum()
        if len(alive):
            self._enter(score, block.ids[alive], block.rows[alive], windows)

    def _enter(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, windows: list[tuple[int, int]]) -> None:
        for k, (floor, top) in enumerate(windows):
            fit = np.flatnonzero((score >= floor) & (score <= top))
            if len(fit) > 8 * self.most:
                last = -np.partition(-score[fit], self.most - 1)[self.most - 1]
                fit = fit[score[fit] >= last]
            fit = fit[np.lexsort((rows[fit], ids[fit], -score[fit]))[: self.most]]
            found = [(-int(score[i]), int(ids[i]), int(rows[i])) for i in fit]
            self.best[k] = sorted(self.best[k] + found)[: self.most]


class Block:
    """Columns of a block: x has one array per dimension."""

    def __init__(self, r: dict, length: int):
        self.n = r["n"]
        self.rows, self.ids, self.labels = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "labels"))
        self.x = np.frombuffer(r["x"], r["kind"]).reshape(length, -1).astype(np.float64)
        self.least, self.largest = self.x.min(1), self.x.max(1)
        self.size = float(max(np.abs(self.least).max(), np.abs(self.largest).max()))
        self._wide: np.ndarray | None = None

    def needs_wide(self, a: np.ndarray) -> bool:
        """Whether sums of products might leave the integers that doubles hold exactly."""
        return self.size * float(np.abs(a).max()) * len(a) >= 2.0**52

    @property
    def wide(self) -> np.ndarray:
        if self._wide is None:
            self._wide = np.array([[int(v) for v in row] for row in self.x], object).reshape(self.x.shape)
            self.wide_least, self.wide_largest = self._wide.min(1), self._wide.max(1)
        return self._wide


def _scan(most: int, same: bool):
    """Blocks and anchors of a chunk and range, anchors first: the best of each anchor and window."""
    schema = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])

    def best_of(anchors: list[Anchor]) -> Iterator[pa.RecordBatch]:
        out = [(a.row, k, max(LEAST, min(MOST, -s)), i, r) for a in anchors for k, best in enumerate(a.best) for s, i, r in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        at, anchors = None, []
        for batch in batches:
            for r in (row for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
                if at != (key := tuple(r[c] for c in DEAL)):
                    yield from best_of(anchors)
                    at, anchors = key, []
                if r["block"] is None:
                    anchors.append(Anchor(r["anchor"], r["label"], np.frombuffer(r["x"], np.float64), r["lows"], r["highs"], most, same))
                    continue
                block = Block(r, key[0])
                for a in anchors:
                    a.scan(block)
        yield from best_of(anchors)

    return run


def _dealt(blocks: DataFrame, anchors: DataFrame, most: int, same: bool, chunk: int, run: int) -> DataFrame:
    """anchor, window, score, vec_id, row: the best of each anchor (anchor, length, label, x, lows, highs) and window."""
    sizes = {r.length: [r.n, 0] for r in blocks.groupBy("length").agg(F.count("*").alias("n")).collect()}
    for r in anchors.groupBy("length").agg(F.count("*").alias("n")).collect():
        sizes[r.length][1] = r.n
    tasks = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    deal = {}
    for length, (n, m) in sizes.items():
        chunks = max(1, math.ceil(m / max(1, min(chunk, chunk * 64 // length))))
        deal[length] = (chunks, max(math.ceil(n / run), min(n, math.ceil(tasks / chunks))))
    spread = lambda k: F.coalesce(*(F.when(F.col("length") == length, F.lit(v[k])) for length, v in deal.items()), F.lit(1))
    dealt = lambda of, c: F.pmod(F.xxhash64(of), spread(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), spread(c) - 1))
    none = lambda fields: [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields.split(", ")]
    own = "anchor long, label long, lows array<long>, highs array<long>"
    left = blocks.withColumn("range", dealt("block", 1)).select("length", each(0).alias("chunk"), "range", *[f.split()[0] for f in _BLOCK.split(", ")], *none(own))
    right = anchors.withColumn("chunk", dealt("anchor", 0)).select("length", "chunk", each(1).alias("range"), *none(_BLOCK.replace(", x binary", "")), "x", *[f.split()[0] for f in own.split(", ")])
    sent = left.unionByName(right).repartition(*DEAL).sortWithinPartitions(*DEAL, F.col("block").asc_nulls_first())
    found = sent.mapInArrow(_scan(most, same), "anchor long, window int, score long, vec_id long, row long")
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, chunk: int = 2048, block_rows: int = 4096, run: int = 32) -> DataFrame:
    """vectors (vec_id, label, embedding); anchors are the rows where is_anchor holds. Each anchor's first `positives` other
    rows of its label, and for each the first `negatives` rows of other labels whose score is from low to high per cent
    of the positive's: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    kept = v.filter(sound(F.col("v")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    # floor in doubles: integers that a long does not hold stay whole
    whole = lambda x: (y := x * scale) - F.pmod(y, F.lit(1.0))
    rows = kept.withColumn("length", F.size("v")).withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * scale).cast("double")).otherwise(whole(x))))
    ordered = rows.repartitionByRange("length", "label", "vec_id").sortWithinPartitions("length", "label", "vec_id").withColumn("row", F.monotonically_increasing_id())
    rows = store(ordered, "numbered")
    blocks = store(rows.select("length", "row", "vec_id", "label", "v").mapInArrow(_blocks(block_rows), f"length int, {_BLOCK}"), "blocks")
    packed = lambda batches: (pa.RecordBatch.from_arrays([*(b.column(c) for c in ("anchor", "anchor_id", "label", "length")), pa.array([np.asarray(x, np.float64).tobytes() for x in b.column("v").to_pylist()], pa.binary())], ["anchor", "anchor_id", "label", "length", "x"]) for b in batches)
    anchors = rows.filter("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "length", "v").mapInArrow(packed, "anchor long, anchor_id long, label long, length int, x binary")
    anchors = store(anchors, "anchors")
    ends = lambda a, b: (F.array(F.lit(a)).alias("lows"), F.array(F.lit(b)).alias("highs"))
    own = _dealt(blocks, anchors.select("anchor", "label", "length", "x", *ends(LEAST, MOST)), positives, True, chunk, run)
    own = store(own.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("p")), "positives")
    # per cent of the positive's score, rounded inwards, in decimals: no product leaves them
    share = lambda x, per_cent: x["positive_score"].cast("decimal(20,0)") * per_cent
    lows = F.transform("p", lambda x: F.ceil(share(x, low) / 100).cast("long"))
    highs = F.transform("p", lambda x: F.floor(share(x, high) / 100).cast("long"))
    queries = store(anchors.join(own, "anchor").withColumn("lows", lows).withColumn("highs", highs), "queries")
    found = _dealt(blocks, queries.select("anchor", "label", "length", "x", "lows", "highs"), negatives, False, chunk, run)
    out = found.join(queries.select("anchor", "anchor_id", "p"), "anchor").withColumn("p", F.get("p", F.col("window")))
    return out.select("anchor_id", "p.positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score"))


def op12(spark, sf_dir: str) -> DataFrame:
    """Over embeddings: labels of ids divisible by 7 moved on by one, anchors are ids divisible by 50."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
