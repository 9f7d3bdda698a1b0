"""Near-duplicate texts: a Jaccard join of word 5-grams with Bayesian pruning of MinHash candidates.

1. Every text gets a MinHash signature of its 5-word shingles. Equal texts are represented by their smallest doc_id.
2. Signatures are cut into bands of 5; texts that share a band are joined through the band's smallest doc_id (a star,
   never all pairs), and the components of these links bound where similar texts can be. Texts alone are done.
3. Within a component, MinHash values of two texts are compared `step` at a time. With a uniform prior, the posterior
   of the similarity after m matches in k is Beta(1 + m, 1 + k - m); a pair is dropped once the posterior probability
   of reaching the threshold is under `tolerance`. The rest are verified exactly on their shingle sets.
   A component of more than `block` texts is cut into classes of size, so that texts at the threshold lie in one class
   or in two that adjoin, and classes into blocks; tasks get pairs of blocks of such classes. Tasks return link counts
   and the edges of a spanning forest, not pairs.
4. Components of the verified links are the classes.

At the threshold of 0.8 a pair misses all 25 bands with probability 5e-5; less similar pairs are cut by step 3.

Words are maximal runs of characters other than the six ASCII white space characters. A text of one to four words has
one shingle, all of it; a text without words (or null) has none and links with nothing but its equals, which count as
copies. A doc_id that occurs more than once is one document: classes of its texts join. Rows with a null doc_id link
with nothing (class null). A very long text is one row of its task. An empty table gives no rows. Shingles are compared by
64-bit hashes. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import group_bounds, ship, slices, store, whole_groups
from tidemill.llm.components import components
from tidemill.llm.text_arrays import Words, mix, window_hashes, window_starts

HASHES, BAND = 128, 5
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _TIMES = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32), (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in turn, and how many each row has."""
    hashes = words.hashes()
    at, counts = window_starts(words.lo, words.hi, k)
    values = window_hashes(hashes, k)[at]
    n = words.hi - words.lo
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return values, counts
    own = np.array([mix(np.array([np.sum(hashes[a:b] * np.arange(3, 3 + b - a, dtype=np.uint64))], np.uint64))[0] for a, b in zip(words.lo[short], words.hi[short], strict=True)], np.uint64)
    where = (np.cumsum(counts) - counts)[short]
    counts = counts.copy()
    counts[short] = 1
    return np.insert(values, where, own), counts


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values, one row of HASHES for each text with shingles."""
    begin = (np.cumsum(counts) - counts)[counts > 0]
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), HASHES), np.uint32)
    for k in range(HASHES):
        y = (x ^ _XOR[k]) * _TIMES[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(y, begin) if len(begin) else 0
    return out


def distinct_counts(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many different shingles each row has."""
    row = np.repeat(np.arange(len(counts)), counts)
    by = np.lexsort((values, row))
    new = np.ones(len(by), bool)
    new[1:] = (values[by][1:] != values[by][:-1]) | (row[by][1:] != row[by][:-1])
    return np.bincount(row[by][new], minlength=len(counts))


def band_keys(sig: np.ndarray) -> np.ndarray:
    n = HASHES // BAND
    x = np.zeros((len(sig), n), np.uint64)
    for i in range(BAND):
        x = mix(x + sig[:, i : n * BAND : BAND])
    return mix(x + np.arange(1, n + 1, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values, counts = shingles(Words(part.column("text")))
            sig = signatures(values, counts)
            has = np.flatnonzero(counts)
            sizes = distinct_counts(values, counts)[has]
            keys = band_keys(sig)
            rows = pa.array(has)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(rows), part.column("text_key").take(rows), pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                ["doc_id", "text_key", "size", "signature", "bands"],
            )


def least_matches(threshold: float, tolerance: float, step: int) -> np.ndarray:
    """For k = step, 2 * step, ...: the fewest matches that leave a posterior probability of `tolerance` at least."""
    out = []
    for k in range(step, HASHES + 1, step):
        # P(Beta(1+m, 1+k-m) >= t) = P(Binomial(k+1, t) <= m)
        n = k + 1
        j = np.arange(n + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
        p = np.exp(logs[n] - logs[j] - logs[n - j] + j * np.log(threshold) + (n - j) * np.log1p(-threshold))
        out.append(int(np.searchsorted(np.cumsum(p), tolerance)))
    return np.array(out)


def _verify(threshold_num: int, threshold_den: int, tolerance: float, step: int):
    least = least_matches(threshold_num / threshold_den, tolerance, step)

    def group(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs (i, j); side: None if all pairs count, else only pairs of different sides do."""
        lengths = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        vocabulary, ids = np.unique(flat, return_inverse=True)
        begin = np.cumsum(lengths) - lengths
        mark = np.zeros(len(vocabulary), bool)
        left, right = [], []
        for i in range(len(sets)):
            others = np.arange(i + 1, len(sets)) if side is None else (np.flatnonzero(side) if not side[i] else np.zeros(0, np.int64))
            short, long = np.minimum(lengths[others], lengths[i]), np.maximum(lengths[others], lengths[i])
            others = others[short * threshold_den >= long * threshold_num]
            matches = np.zeros(len(others), np.int64)
            for r, m in enumerate(least):
                if not len(others):
                    break
                cols = slice(r * step, (r + 1) * step)
                matches += (sig[others, cols] == sig[i, cols]).sum(1)
                keep = matches >= m
                others, matches = others[keep], matches[keep]
            if not len(others):
                continue
            mark[ids[begin[i] : begin[i] + lengths[i]]] = True
            at = np.concatenate([np.arange(begin[j], begin[j] + lengths[j]) for j in others])
            inter = np.add.reduceat(mark[ids[at]].astype(np.int64), np.cumsum(lengths[others]) - lengths[others])
            mark[ids[begin[i] : begin[i] + lengths[i]]] = False
            linked = others[inter * threshold_den >= threshold_num * (lengths[i] + lengths[others] - inter)]
            left.append(np.full(len(linked), i))
            right.append(linked)
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["component", "x", "y"]
        for t in whole_groups(batches, keys, 4_000):
            words = Words(flat(t.column("text")))
            values, counts = shingles(words)
            end = np.cumsum(counts)
            node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
            block, x, y = (t.column(c).to_numpy() for c in ("own", "x", "y"))
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            bounds = group_bounds(t.column("component").to_numpy(), x, y)
            out: list[tuple[int, int | None, int]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                sets = [np.unique(values[end[r] - counts[r] : end[r]]) for r in range(a, b)]
                side = None if x[a] == y[a] else block[a:b] == y[a]
                left, right = group(sig[a:b], sets, side)
                links = np.zeros(b - a, np.int64)
                np.add.at(links, left, copies[a:b][right])
                np.add.at(links, right, copies[a:b][left])
                out += [(int(node[a + i]), None, int(links[i])) for i in np.flatnonzero(links)]
                out += [(int(node[a + i]), int(node[a + j]), 0) for i, j in forest(b - a, left.tolist(), right.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["a", "b", "links"])

    return run


def flat(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def forest(n: int, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    root, out = list(range(n)), []
    for i, j in zip(left, right, strict=True):
        a, b = i, j
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def _blocks_of(size_class: Column) -> Column:
    """Names of the blocks of a class of the row's component; none if it has no such class."""
    n = F.coalesce(F.try_element_at("blocks", size_class), F.lit(0)).cast("long")
    names = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda k: F.shiftleft(size_class, 32) + k)
    return F.slice(names, F.lit(1), n.cast("int"))


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (4, 5), tolerance: float = 1e-5, step: int = 16, block: int = 256) -> DataFrame:
    """Per row of docs: doc_id, class_id (smallest doc_id of its class), n_links (other documents at the threshold or
    above, copies included), kept (doc_id = class_id)."""
    ship(docs.sparkSession)
    keyed = docs.select("doc_id", F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("text_key"), "text")
    rows = store(keyed.select("doc_id", "text_key"), "rows")
    texts = rows.filter("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    signed = store(keyed.filter("doc_id is not null").mapInArrow(_sign, "doc_id long, text_key binary, size long, signature binary, bands array<long>"), "signatures")
    texts = store(texts, "texts")
    of_texts = signed.join(texts.select(F.col("node").alias("doc_id"), "text_key", "copies"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    of_texts = store(of_texts.withColumnRenamed("doc_id", "node"), "texts")

    banded = of_texts.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("band", "hub")
    stars = banded.join(shared, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    where = store(components(stars), "candidates")

    # sets at the threshold differ in size by den / num at most; the margin keeps rounding from moving one two classes on
    size_class = F.floor(F.log(F.col("size")) / (math.log(threshold[1] / threshold[0]) * (1 + 1e-7)))
    members = where.join(of_texts.select("node", "text_key", "copies", "size", "signature"), "node").withColumn("class", size_class)
    per_class = members.groupBy("component", "class").agg(F.count("*").alias("n"))
    per_class = per_class.select("component", "n", F.struct("class", F.ceil(F.col("n") / block).alias("blocks")).alias("entry"))
    plan = per_class.groupBy("component").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list("entry")).alias("blocks"))
    members = members.join(plan, "component")
    members = members.join(keyed.select(F.col("doc_id").alias("node"), "text_key", "text"), ["node", "text_key"]).dropDuplicates(["node", "text_key"])
    whole = F.col("total") <= block
    place = F.pmod(F.xxhash64("text_key"), F.try_element_at("blocks", F.col("class")))
    own = F.when(whole, F.lit(0)).otherwise(F.shiftleft(F.col("class"), 32) + place).cast("long")
    others = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.flatten(F.transform(F.sequence(F.col("class") - 1, F.col("class") + 1), _blocks_of)))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(others)).select(
        "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "copies", "signature", "text"
    )
    dealt = dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    found = store(dealt.mapInArrow(_verify(*threshold, tolerance, step), "a long, b long, links long"), "links")

    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    several = rows.groupBy("doc_id").agg(F.min("text_key").alias("k"), F.max("text_key").alias("l")).filter("k <> l").select("doc_id")
    same_id = rows.join(several, "doc_id").join(texts, "text_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    classes = components(found.filter("b is not null").select("a", "b").union(same_id))
    of_node = texts.select("node", "text_key", "copies").join(links, "node", "left").join(classes, "node", "left")
    of_text = of_node.select("text_key", F.coalesce("component", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    none = F.col("doc_id").isNull()
    return rows.join(of_text, "text_key", "left").select("doc_id", F.when(~none, F.col("class_id")).alias("class_id"), F.when(none, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), (F.col("doc_id") == F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of docs per class: of the smallest doc_id, then by its text and its other columns. A row with a null doc_id
    counts as a document named by a hash of its text, and stays only where its class has no row with an id."""
    key = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    name = F.coalesce("doc_id", F.xxhash64(key)).alias("doc_id")
    classes = near_duplicates(docs.select(name, "text"), **options).select(F.col("doc_id").alias("_name"), F.col("class_id").alias("_class")).distinct()
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), name, key.alias("text_key"), whole.alias("whole"))
    ranks = docs.select(name.alias("_name"), rank.alias("_rank"))
    first = ranks.join(classes, "_name").groupBy("_class").agg(F.min("_rank").alias("_rank")).select("_rank.*").withColumnsRenamed({"unnamed": "_a", "doc_id": "_b", "text_key": "_c", "whole": "_d"})
    first = store(first, "first")
    marked = docs.select("*", rank.alias("_rank")).select("*", *[F.col(f"_rank.{c}").alias(k) for c, k in (("unnamed", "_a"), ("doc_id", "_b"), ("text_key", "_c"), ("whole", "_d"))])
    keys = ["_a", "_b", "_c", "_d"]
    return marked.join(first, keys, "left_semi").dropDuplicates(keys).select([F.col(f"`{c}`") for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
