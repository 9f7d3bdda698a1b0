"""Removal of repeated word windows by super-k-mer partitioning.

A window is `window` consecutive words of one document. Its minimiser is the least hash among the runs of `seed`
words in it; consecutive windows that share the occurrence of their minimiser (a super-k-mer) travel as one packed
string to the minimiser's bucket. There the windows of all strings are sorted and equal ones counted exactly (equal
hashes are followed by a comparison of the words).

A first pass counts super-k-mers per minimiser, all of them, in one aggregation. A window that occurs twice has a
minimiser that is counted twice, so only super-k-mers of such minimisers travel: a Bloom filter of FILTER_BITS, built by
aggregation and sent to the tasks, keeps back almost all others (beyond some 10**8 repeated minimisers it fills up and
keeps back less; results do not depend on it). A minimiser counted more than `hot_rows` times is hot: its strings are
dealt by where they stand (equal strings as well) to as many tasks as leave each about half of `hot_rows`; each settles
the windows that it has twice, and passes on one digest of each distinct window; digests that several tasks pass on are
repeated as well. So no task gets a whole hot bucket. Hot minimisers stay a table, which Spark broadcasts if it is small.

Null text counts as empty: no words. Rows that share doc_id and text are copies of each other like any other rows;
rows that share only doc_id (or have none) are kept apart by a 64-bit hash of the text. A very long text is cut by
nothing: it is one row of its task, at some sixty times its size. Ties of minimisers go to the leftmost. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import group_bounds, ship, slices, store, whole_groups
from tidemill.llm.text_arrays import Words, mix, window_hashes, window_starts

_LOW = np.uint64((1 << 24) - 1)
FILTER_BITS = 1 << 28


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    s = 1
    while 2 * s <= w:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def super_kmers(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, number of windows and minimiser of each super-k-mer."""
    at, counts = window_starts(words.lo, words.hi, window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    seeds = window_hashes(words.hashes(), seed)
    row_of_word = np.repeat(np.arange(len(words.lo)), words.hi - words.lo)
    place = (np.arange(len(seeds)) - words.lo[row_of_word[: len(seeds)]]).astype(np.uint64)
    least = sliding_min((seeds & ~_LOW) | (place & _LOW), window - seed + 1)[at]
    row = np.repeat(np.arange(len(counts)), counts)
    begin = group_bounds(row, least)
    first = begin[:-1]
    return row[first], at[first], np.diff(begin), (least[first] >> np.uint64(24)).astype(np.int64)


def _census(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, n = np.unique(super_kmers(Words(part.column("text")), window, seed)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["bucket", "n"])

    return run


def filter_places(bucket: np.ndarray) -> np.ndarray:
    """The two bits of each bucket in the filter."""
    x = mix(bucket.astype(np.uint64))
    return np.stack([x % np.uint64(FILTER_BITS), (x >> np.uint64(32)) % np.uint64(FILTER_BITS)]).astype(np.int64)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = filter_places(batch.column("bucket").to_numpy()).ravel()
        yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])


def bucket_filter(buckets: DataFrame) -> np.ndarray:
    """Bits of all buckets: FILTER_BITS / 64 longs at most come to the driver."""
    words = buckets.select("bucket").mapInArrow(_filter_words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _pack(window: int, seed: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                row, start, n, bucket = super_kmers(words, window, seed)
                at = filter_places(bucket)
                seen = np.flatnonzero((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(0))
                if not len(seen):
                    continue
                row, start, n, bucket = row[seen], start[seen], n[seen], bucket[seen]
                joined, at = words.spaced()
                lo, hi = at[start], at[start + n + window - 1] - 1
                packed = [joined[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("text_key").take(rows), pa.array((start - words.lo[row]).astype(np.int32)), pa.array(bucket), pa.array(packed, pa.binary())],
                    ["doc_id", "text_key", "place", "bucket", "packed"],
                )

    return run


def _count(window: int):
    def settle(t: pa.Table) -> pa.RecordBatch:
        packed = t.column("packed").combine_chunks()
        if isinstance(packed, pa.ChunkedArray):
            packed = packed.chunk(0)
        words = Words(packed)
        at, counts = window_starts(words.lo, words.hi, window)
        hashes = window_hashes(words.hashes(), window)[at]
        row = np.repeat(np.arange(len(counts)), counts)
        bounds = group_bounds(t.column("bucket").to_numpy(), t.column("salt").to_numpy())
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keyed = mix(hashes ^ (group[row].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        order = np.argsort(keyed, kind="stable")
        begin = group_bounds(keyed[order])
        size = np.diff(begin)
        joined, byte = words.spaced()
        text = lambda w: joined[byte[at[w]] : byte[at[w] + window] - 1]
        repeated = np.zeros(len(at), bool)
        heads = np.ones(len(at), bool)  # the first of each set of equal windows here
        for a, n in zip(begin[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
            members = order[a : a + n].tolist()
            first = text(members[0])
            if all(text(w) == first for w in members[1:]):
                repeated[members] = True
                heads[members[1:]] = False
                continue
            by_text: dict[bytes, list[int]] = {}
            for w in members:
                by_text.setdefault(text(w), []).append(w)
            for same in by_text.values():
                repeated[same] = len(same) > 1
                heads[same[1:]] = False
        offset = at - words.lo[row] + t.column("place").to_numpy()[row]
        found = np.flatnonzero(repeated)
        cut = group_bounds(row[found], found - np.arange(len(found)))
        first, last = found[cut[:-1]], found[cut[1:] - 1] if len(found) else found
        salted = t.column("salt").to_numpy()[row] >= 0
        opened = np.flatnonzero(salted & heads)
        digests = [hashlib.blake2b(text(w), digest_size=16).digest() for w in opened.tolist()]
        rows = np.concatenate([row[first], row[opened]])
        lo = np.concatenate([offset[first], offset[opened]]).astype(np.int32)
        hi = np.concatenate([offset[last] + window, offset[opened] + window]).astype(np.int32)
        n = np.concatenate([np.zeros(len(first), np.int32), 1 + repeated[opened].astype(np.int32)])
        at_rows = pa.array(rows.astype(np.int64))
        take = lambda c: t.column(c).combine_chunks().take(at_rows)
        flat = lambda a: a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        return pa.RecordBatch.from_arrays(
            [flat(take("doc_id")), flat(take("text_key")), pa.array(lo), pa.array(hi), pa.array([None] * len(first) + digests, pa.binary()), pa.array(n.astype(np.int32))],
            ["doc_id", "text_key", "lo", "hi", "digest", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket", "salt"]):
            yield settle(t)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            spans = part.column("spans")
            at = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1]
            row = np.repeat(np.arange(len(spans)), np.diff(at))
            inner = spans.values.slice(int(at[0]), int(at[-1] - at[0])) if len(row) else None
            edge = np.zeros(len(words) + 1, np.int64)
            if inner is not None:
                lo, hi = inner.field("lo").to_numpy(), inner.field("hi").to_numpy()
                np.add.at(edge, words.lo[row] + lo, 1)
                np.add.at(edge, words.lo[row] + hi, -1)
            gone = np.cumsum(edge)[:-1] > 0
            before = np.append(0, np.cumsum(gone))
            kept = Words.__new__(Words)
            kept.buf = words.buf.copy()
            for a, b in zip(words.starts[gone].tolist(), words.ends[gone].tolist(), strict=True) if gone.sum() < 2000 else ():
                kept.buf[a:b] = 32
            if gone.sum() >= 2000:
                edges = np.zeros(len(words.buf) + 1, np.int8)
                edges[words.starts[gone]] += 1
                edges[words.ends[gone]] -= 1
                kept.buf[np.cumsum(edges)[:-1] > 0] = 32
            kept.starts, kept.ends = words.starts[~gone], words.ends[~gone]
            joined, byte = kept.spaced()
            to = np.arange(len(words) + 1) - before
            lo, hi = byte[to[words.lo]], byte[to[words.hi]]
            texts = [joined[a : max(a, b - 1)] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array((words.hi - words.lo).astype(np.int64)), pa.array((before[words.hi] - before[words.lo]).astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )


def _text_key():
    return F.xxhash64("text").alias("text_key")


def repeated_spans(docs: DataFrame, window: int = 35, seed: int | None = None, hot_rows: int = 2_000) -> DataFrame:
    """Word spans [lo, hi) of repeated windows: doc_id, text_key (a hash of the text), lo, hi. seed: a quarter of the window."""
    seed = seed or max(1, window // 4)
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", _text_key(), "text")
    counts = docs.select("text").mapInArrow(_census(window, seed), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    repeated = store(counts.filter("n > 1"), "census")
    packed = docs.mapInArrow(_pack(window, seed, bucket_filter(repeated)), "doc_id long, text_key long, place int, bucket long, packed binary")
    hot = store(repeated.filter(F.col("n") > hot_rows).select("bucket", F.ceil(2 * F.col("n") / hot_rows).cast("int").alias("parts")), "hot")
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "text_key", "place"), F.col("parts")).cast("int"), F.lit(-1)).alias("salt")
    dealt = packed.join(hot, "bucket", "left").select("doc_id", "text_key", "place", "bucket", salt, "packed")
    dealt = dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
    marks = store(dealt.mapInArrow(_count(window), "doc_id long, text_key long, lo int, hi int, digest binary, n int"), "windows")
    opened = marks.filter("digest is not null")
    often = opened.groupBy("digest").agg(F.sum("n").alias("total")).filter("total > 1").select("digest")
    spans = marks.filter("digest is null").select("doc_id", "text_key", "lo", "hi")
    return spans.unionByName(opened.filter("n = 1").join(often, "digest").select("doc_id", "text_key", "lo", "hi"))


def collected(spans: DataFrame) -> DataFrame:
    """doc_id, text_key, spans: each span once, however many rows have that doc_id and text."""
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def remove_repeated(docs: DataFrame, window: int = 35, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spans = collected(repeated_spans(docs, window, **options))
    keyed = docs.select("doc_id", _text_key(), "text")
    s = spans.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "spans")
    joined = keyed.join(s, keyed.doc_id.eqNullSafe(s._d) & (keyed.text_key == s._k), "left")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    return joined.select("doc_id", "text", F.coalesce("spans", none).alias("spans")).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")


def op6(spark, sf_dir: str) -> DataFrame:
    """Windows of 35 words over all documents; kept_sha256 is the digest of kept_text."""
    out = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
