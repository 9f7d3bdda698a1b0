"""Benchmark decontamination by greedy string tiling.

Tokens are maximal runs of ASCII letters and digits and of all other non-ASCII characters, in lower case; everything
else separates. Every run of `tile` tokens of a benchmark item is a seed (a Karp-Rabin hash). Texts are joined with the
seeds; a pair of text and item that share one is tiled: again and again the longest match of tokens that no tile has
yet becomes a tile (ties: first in the item, then in the text), down to matches of `tile` tokens. Matches are found by
the rolling hashes of their seeds on each diagonal and need not keep their order, so reordered passages count in full.
A text is contaminated by an item when tiles hold `threshold` of the item's tokens at least.

The seeds of up to `most_seeds` (a proven bound) are sent to all tasks. Those of a larger benchmark stay a table: texts
give those of their seeds that a Bloom filter of fixed size may hold, both tables are joined, and pairs whose shared
seeds cannot cover `threshold` of the item (a seed covers `tile` tokens at most) go before any text travels. Both ways
give the same pairs. Tiling needs one text and one item at a time.

Null and empty texts match nothing; items of fewer than `tile` tokens (or null) are not looked for. Equal items and
rows with equal doc_id are reported one by one. A very long text is one row of its task; one that repeats few tokens is
matched in pieces of `most` matches, of which only maximal runs are kept. Ties of tiles are settled as above. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import ship, slices, store
from tidemill.llm.substring_dedup import bucket_filter, filter_places
from tidemill.llm.text_arrays import Words, window_hashes, window_starts

_BYTES = np.full(256, 32, np.uint8)
_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
_BYTES[0x80:] = np.arange(0x80, 0x100)

_SCHEMA = "doc_id long, item_id long, coverage double, tiles int, longest int"


def tokens(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts), _BYTES)


def runs(a: np.ndarray, b: np.ndarray, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal values along diagonals: place in a, place in b, length. About `most` matches are listed at
    once; a run that the next piece goes on with is put together at the end."""
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    matches = np.cumsum(hi - lo)
    parts, at = [np.zeros((3, 0), np.int64)], 0
    while at < len(b):
        end = max(int(np.searchsorted(matches, (matches[at - 1] if at else 0) + most, "right")), at + 1)
        n = hi[at:end] - lo[at:end]
        j = np.repeat(np.arange(at, end), n)
        i = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:end], n)]
        parts.append(_joined(i, j, np.ones(len(i), np.int64)))
        at = end
    i, j, n = np.concatenate(parts, axis=1)
    return tuple(_joined(i, j, n)) if len(parts) > 2 else (i, j, n)


def _joined(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs (i, j, n), those that follow each other on a diagonal as one."""
    by = np.lexsort((i, j - i))
    i, j, n = i[by], j[by], n[by]
    first = np.ones(len(i), bool)
    first[1:] = (np.diff(j - i) != 0) | (i[1:] != i[:-1] + n[:-1])
    at = np.flatnonzero(first)
    return np.stack([i[at], j[at], np.add.reduceat(n, at) if len(at) else n])


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the text, length) of two arrays of token hashes."""
    a, b = window_hashes(item, least), window_hashes(text, least)
    if not len(a) or not len(b):
        return []
    i, j, n = runs(a, b)
    heap = list(zip((-(n + least - 1)).tolist(), i.tolist(), j.tolist(), strict=True))
    heapify(heap)
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out = []
    while heap:
        m, p, q = heappop(heap)
        m = -m
        taken = in_item[p : p + m] | in_text[q : q + m]
        if not taken.any():
            in_item[p : p + m] = True
            in_text[q : q + m] = True
            out.append((p, q, m))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= least:
                heappush(heap, (s - e, p + s, q + s))
    return out


class Items:
    """Benchmark items as token hashes, and which items have a seed."""

    def __init__(self, item_ids: list[int], texts: list[str], tile: int):
        words = tokens(pa.array(texts, pa.string()))
        hashes = words.hashes()
        at, counts = window_starts(words.lo, words.hi, tile)
        self.ids = item_ids
        self.tokens = [hashes[a:b] for a, b in zip(words.lo, words.hi, strict=True)]
        seed = window_hashes(hashes, tile)[at]
        owner = np.repeat(np.arange(len(texts)), counts)
        order = np.lexsort((owner, seed))
        self.seeds, self.owners = seed[order], owner[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seeds >> np.uint64(44)).astype(np.int64)] = True


def _match(items: Items, tile: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = tokens(part.column("text"))
                hashes = words.hashes()
                at, counts = window_starts(words.lo, words.hi, tile)
                seed = window_hashes(hashes, tile)[at]
                row = np.repeat(np.arange(len(counts)), counts)
                hit = np.flatnonzero(items.maybe[(seed >> np.uint64(44)).astype(np.int64)])
                lo, hi = np.searchsorted(items.seeds, seed[hit], "left"), np.searchsorted(items.seeds, seed[hit], "right")
                n = hi - lo
                owner = items.owners[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                pairs = np.unique(np.stack([np.repeat(row[hit], n), owner]), axis=1) if len(owner) else np.zeros((2, 0), np.int64)
                rows, out = [], []
                for r, k in pairs.T.tolist():
                    item = items.tokens[k]
                    found = tiles(item, hashes[words.lo[r] : words.hi[r]], tile)
                    coverage = sum(m for _, _, m in found) / len(item)
                    if coverage >= threshold:
                        rows.append(r)
                        out.append((items.ids[k], coverage, len(found), max(m for _, _, m in found)))
                cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True))], ["doc_id", "item_id", "coverage", "tiles", "longest"])

    return run


def _seeds(tile: int, key: str, bits: np.ndarray | None = None):
    """Seeds of texts with how often each occurs and the text's tokens; bits: only those that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = tokens(part.column("text"))
                at, counts = window_starts(words.lo, words.hi, tile)
                seed = window_hashes(words.hashes(), tile)[at].view(np.int64)
                row = np.repeat(np.arange(len(counts)), counts)
                if bits is not None:
                    place = filter_places(seed)
                    may = (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).all(0)
                    seed, row = seed[may], row[may]
                (row, seed), times = np.unique(np.stack([row, seed]), axis=1, return_counts=True) if len(seed) else ((row, seed), row)
                size = (words.hi - words.lo)[row]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array(seed), pa.array(times, pa.int64()), pa.array(size, pa.int64())], [key, "seed", "times", "size"])

    return run


def _tile_pairs(tile: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, items = tokens(part.column("text")), tokens(part.column("item"))
                of_text, of_item = texts.hashes(), items.hashes()
                rows, out = [], []
                for r in range(part.num_rows):
                    item = of_item[items.lo[r] : items.hi[r]]
                    found = tiles(item, of_text[texts.lo[r] : texts.hi[r]], tile)
                    coverage = sum(m for _, _, m in found) / len(item)
                    if coverage >= threshold:
                        rows.append(r)
                        out.append((coverage, len(found), max(m for _, _, m in found)))
                cols = list(zip(*out, strict=True)) if out else [(), (), ()]
                keys = [part.column(k).take(pa.array(rows, pa.int64())) for k in ("text_key", "item_key")]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int32(), pa.int32()), strict=True))], ["text_key", "item_key", "coverage", "tiles", "longest"])

    return run


def _by_join(docs: DataFrame, texts: DataFrame, tile: int, threshold: float) -> DataFrame:
    """contaminated() for a benchmark of any size: seeds are joined as tables, distinct texts with distinct items."""
    digest = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    items = store(texts.withColumn("item_key", digest("text")), "items")
    item_seeds = store(items.dropDuplicates(["item_key"]).select("item_key", "text").mapInArrow(_seeds(tile, "item_key"), "item_key binary, seed long, times long, size long"), "item-seeds")
    bits = bucket_filter(item_seeds.select(F.col("seed").alias("bucket")))
    keyed = docs.filter("text is not null").select("doc_id", digest("text").alias("text_key"), "text")
    seeds = keyed.select("text_key", "text").mapInArrow(_seeds(tile, "text_key", bits), "text_key binary, seed long, times long, size long")
    shared = seeds.select("text_key", "seed").distinct().join(item_seeds, "seed").groupBy("text_key", "item_key").agg(F.sum("times").alias("times"), F.first("size").alias("size"))
    pairs = store(shared.filter(F.col("times") * tile >= F.col("size") * (threshold - 1e-9)).select("text_key", "item_key"), "pairs")
    wanted = keyed.join(pairs.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", "text")
    both = pairs.join(items.dropDuplicates(["item_key"]).select("item_key", F.col("text").alias("item")), "item_key").join(wanted, "text_key")
    found = store(both.mapInArrow(_tile_pairs(tile, threshold), "text_key binary, item_key binary, coverage double, tiles int, longest int"), "tiled")
    return keyed.select("doc_id", "text_key").join(found, "text_key").join(items.select("item_key", "item_id"), "item_key").select("doc_id", "item_id", "coverage", "tiles", "longest")


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = 4, threshold: float = 0.6, most_seeds: int = 500_000) -> DataFrame:
    """Pairs of document and item at the threshold or above: doc_id, item_id, coverage, tiles, longest (tokens)."""
    ship(docs.sparkSession)
    texts = benchmark.filter("text is not null").select("item_id", "text")
    total = texts.agg(F.sum(F.length("text")).alias("n")).first().n or 0  # a text has fewer seeds than characters
    if total > most_seeds:
        return _by_join(docs, texts, tile, threshold)
    own = texts.orderBy("item_id").collect()
    items = Items([r.item_id for r in own], [r.text for r in own], tile)
    return docs.select("doc_id", "text").mapInArrow(_match(items, tile, threshold), _SCHEMA)


def op3(spark, sf_dir: str) -> DataFrame:
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no benchmark item contaminates; rows with a null doc_id are checked as well."""
    row = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any name that docs has
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = contaminated(marked.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(docs.columns)
