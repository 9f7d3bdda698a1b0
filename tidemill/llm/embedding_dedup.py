"""Near-duplicate vectors by cosine: a subspace pigeonhole join.

Unit vectors with cosine c have squared distance 2 - 2c. After a fixed random rotation the vectors are cut into
`blocks` blocks of coordinates; a pair within the threshold is, in one block at least, within that block's share of
the squared distance (in proportion to its coordinates). Each block is range-joined under its budget: vectors at home are
cut into slabs along the block's first coordinate, and meet the vectors that the block's radius around their slab reaches.
In a slab the distances within the block pick the candidates, of which the first block that accepts a pair keeps it, and
the cosine of the vectors themselves is verified in double precision.

Vectors are dealt, once, into chunks of about `chunk` vectors (and 16 MB at most, on average), and each chunk is stored as one row. Every two chunks (and every
chunk with itself) are a row of a Cartesian product of that table, in which tasks read the chunks they need from the shared folder:
nothing is shuffled for a pair of chunks, so the disk grows with the table only, and a task holds two chunks at a time. Equal
vectors are joined once. Tasks return link counts and the edges of a spanning forest, not pairs. At a cosine of 0.9 no exact
partition of such vectors is selective, so the pairs compared still grow with the square of the number of distinct vectors;
slabs and budgets only lower the factor. The bytes read grow with that square / `chunk`.

Vectors that are null, zero or have null or non-finite components, and vectors of different lengths, link with
nothing. Vectors of any finite magnitude link: each is first scaled by the power of two that brings its largest component near
one (which is exact; components 1e290 times smaller than it count as zero), so no square over- or underflows. Rows with equal vec_id are one node. A null vec_id gets no links and a
null component. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import group_bounds, lean_memory, ship, store, whole_groups
from tidemill.llm.components import components

PACK = "length int, kind string, nodes binary, copies binary, v binary"
CHUNK_BYTES = 16 << 20  # of a chunk's components as doubles
PAIR = ["number", "kind", "nodes", "copies", "v"]  # of each of two packs


class Space:
    """Rotation, blocks and budgets for vectors of one length, and the slabs that a chunk has at least."""

    def __init__(self, length: int, cosine: float, blocks: int, slabs: int):
        rng = np.random.default_rng(20_241)
        q, r = np.linalg.qr(rng.standard_normal((length, length)))
        self.rotation = np.ascontiguousarray((q * np.sign(np.diag(r))).T)
        self.cuts = [c for c in np.array_split(np.arange(length), min(blocks, length))]
        self.budgets = [(2 - 2 * cosine) * len(c) / length * (1 + 1e-6) + 1e-9 for c in self.cuts]
        self.slabs = slabs


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _deal(spaces: dict[int, Space], chunks: dict[tuple[int], int] | None):
    """Rows of (length, chunk, ...): a vector's chunk follows from its components. Without chunks, only counts by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in spaces:
                part = batch.filter(pa.array(lengths == length))
                n = part.num_rows
                if n and chunks is None:
                    yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([n], pa.int64())], ["length", "n"])
                elif n:
                    odd = np.random.default_rng(length).integers(0, 1 << 63, length, np.uint64) * np.uint64(2) + np.uint64(1)
                    spread = (matrix(part.column("v")).view(np.uint64) * odd).sum(1) >> np.uint64(32)
                    chunk = (spread % np.uint64(chunks[length,])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, length, np.int32)), pa.array(chunk), *(part.column(c) for c in ("node", "copies", "v"))], ["length", "chunk", "node", "copies", "v"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as rows; components are stored as floats where these hold them exactly."""
    for t in whole_groups(batches, ["length", "chunk"]):
        lengths, node, copies = (t.column(c).to_numpy() for c in ("length", "node", "copies"))
        bounds = group_bounds(lengths, t.column("chunk").to_numpy())
        for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            v = t.column("v").slice(a, e - a).combine_chunks()
            x = matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)
            with np.errstate(over="ignore", under="ignore"):
                short = x.astype(np.float32)
            kind, x = ("f4", short) if (short == x).all() else ("f8", x)
            row = [int(lengths[a]), kind, node[a:e].tobytes(), copies[a:e].tobytes(), x.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([r], k) for r, k in zip(row, (pa.int32(), pa.string(), *[pa.binary()] * 3), strict=True)], ["length", "kind", "nodes", "copies", "v"])


class Block:
    """The vectors of a chunk within one block: coordinates, the order of the first one, and in that order what gives squared
    distances as one product (at home @ met)."""

    def __init__(self, y: np.ndarray):
        self.y = np.ascontiguousarray(y)
        self.order = np.argsort(y[:, 0], kind="stable")
        z = self.y[self.order].astype(np.float32)
        self.first = self.y[self.order, 0]
        square, one = (z * z).sum(1)[:, None], np.ones((len(z), 1), np.float32)
        self.home, self.met = np.hstack([z, square, one]), np.ascontiguousarray(np.hstack([-2 * z, one, square]).T)


class Chunk:
    """The vectors of one pack."""

    def __init__(self, space: Space, kind: str, nodes: pa.Buffer, copies: pa.Buffer, v: pa.Buffer):
        self.nodes, self.copies = np.frombuffer(nodes, np.int64), np.frombuffer(copies, np.int64)
        self.x = np.frombuffer(v, kind).astype(np.float64).reshape(len(self.nodes), -1)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        y = (self.x / self.norm[:, None]) @ space.rotation.T
        self.blocks = [Block(y[:, cut]) for cut in space.cuts]


def _linked(space: Space, cosine: float, a: Chunk, b: Chunk, tile: int = 256, part: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a vector of a and one of b, each once; of one chunk, all its pairs."""

    def apart(k: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        gap = a.blocks[k].y[p] - b.blocks[k].y[q]
        return (gap * gap).sum(1)

    tile = max(1, min(tile, -(-len(a.nodes) // space.slabs)))
    for k, budget in enumerate(space.budgets):
        home, met = a.blocks[k], b.blocks[k]
        radius, limit = np.sqrt(budget) * (1 + 1e-9), np.float32(budget + 1e-4)
        for at in range(0, len(a.nodes), tile):
            end = min(at + tile, len(a.nodes))
            low = at if a is b else int(np.searchsorted(met.first, home.first[at] - radius, "left"))
            high = int(np.searchsorted(met.first, home.first[end - 1] + radius, "right"))
            i, j = np.nonzero(home.home[at:end] @ met.met[:, low:high] <= limit)
            i, j = i + at, j + low
            if a is b:
                i, j = i[j > i], j[j > i]
            for lo in range(0, len(i), part):
                p, q = home.order[i[lo : lo + part]], met.order[j[lo : lo + part]]
                near = apart(k, p, q) <= budget
                p, q = p[near], q[near]
                for c in range(k):
                    new = apart(c, p, q) > space.budgets[c]
                    p, q = p[new], q[new]
                near = np.einsum("ij,ij->i", a.x[p], b.x[q]) / (a.norm[p] * b.norm[q]) >= cosine
                if near.any():
                    yield p[near], q[near]


def _merge(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """root (of each, the one that stands for its component) after these pairs, and edges that join what was apart."""
    r, s = root[left], root[right]
    out = []
    for x, y in np.unique(np.stack([r, s])[:, r != s], axis=1).T.tolist():
        while root[x] != x:
            x = int(root[x])
        while root[y] != y:
            y = int(root[y])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((x, y))
    while out and (root[root] != root).any():
        root = root[root]
    return root, out


def _join(spaces: dict[int, Space], cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        number, a = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                space = spaces[batch.column("length")[k].as_py()]
                one, other = ([batch.column(f"{side}_{c}")[k] for c in PAIR] for side in "ab")
                read = lambda row, space=space: Chunk(space, row[1].as_py(), *(x.as_buffer() for x in row[2:]))
                if number != one[0].as_py():
                    number, a = one[0].as_py(), read(one)
                b = a if other[0].as_py() == number else read(other)
                shift = 0 if a is b else len(a.nodes)
                nodes, copies = (getattr(a, c) if a is b else np.concatenate([getattr(a, c), getattr(b, c)]) for c in ("nodes", "copies"))
                links, root, edges = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), []
                for left, right in _linked(space, cosine, a, b):
                    right = right + shift
                    np.add.at(links, left, copies[right])
                    np.add.at(links, right, copies[left])
                    root, new = _merge(root, left, right)
                    edges += new
                some = np.flatnonzero(links)
                if len(some):
                    x, y = np.array(edges).T
                    nothing = pa.nulls(len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), nothing, pa.array(links[some])], ["a", "b", "links"])
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y]), pa.array(np.zeros(len(x), np.int64))], ["a", "b", "links"])

    return run


def _pairs(packs: DataFrame) -> DataFrame:
    """Of every two packs of one length, one of their two orders (taken in turn, which gives tasks equal shares), and every pack with itself."""
    a, b = (packs.select(F.col("length").alias(f"{side}_length"), *(F.col(c).alias(f"{side}_{c}") for c in PAIR)) for side in "ab")
    low, high = F.col("a_number") < F.col("b_number"), F.col("a_number") > F.col("b_number")
    even = (F.col("a_number") + F.col("b_number")) % 2 == 0
    one_length = F.col("a_length") - F.col("b_length") == 0  # no key of a join: a length's packs would go to one task
    return a.crossJoin(b.hint("shuffle_replicate_nl")).filter(one_length & ((low & even) | (high & ~even) | (~low & ~high))).withColumn("length", F.col("a_length"))


def link_vectors(vectors: DataFrame, cosine: float = 0.9, blocks: int = 4, slabs: int = 8, chunk: int = 8192) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("embedding").cast("array<double>")
    largest = F.array_max(F.transform(v, F.abs))
    power = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(largest)).cast("double")))
    scaled = F.zip_with(v, F.array_repeat(F.pow(F.lit(2.0), power), F.size(v)), lambda x, p: x * p + F.lit(0.0))
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    key = F.unhex(F.md5(F.to_binary(F.array_join(F.transform(scaled, lambda x: x.cast("string")), ","), F.lit("utf-8"))))
    keyed = store(vectors.select("vec_id", F.when(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull(), key).alias("key"), "embedding"), "vectors")
    distinct = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    nodes = store(distinct.withColumn("length", F.size("embedding")), "nodes")
    spaces = {r.length: Space(r.length, cosine, blocks, slabs) for r in nodes.select("length").distinct().collect()}
    plain = nodes.select("node", "copies", scaled.alias("v"), "length")
    counts = plain.mapInArrow(_deal(spaces, None), "length int, n long").groupBy("length").agg(F.sum("n").alias("n")).collect()
    cores = spark.sparkContext.defaultParallelism
    most = {r.length: min(chunk, max(1, CHUNK_BYTES // (8 * r.length)), max(1024, -(-r.n // cores))) for r in counts}  # smaller ones where not every core had one
    chunks = {(r.length,): -(-r.n // most[r.length]) for r in counts}
    dealt = plain.mapInArrow(_deal(spaces, chunks), "length int, chunk int, node long, copies long, v array<double>")
    whole = dealt.repartition(max(1, sum(chunks.values())), "length", "chunk").sortWithinPartitions("length", "chunk").mapInArrow(_pack, PACK)
    packs = store(whole.withColumn("number", F.monotonically_increasing_id()), "packs")
    found = store(_pairs(packs).mapInArrow(_join(spaces, cosine), "a long, b long, links long"), "links")
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    owners = keyed.select("vec_id", "key").join(nodes.select("key", "node"), "key")
    several = owners.groupBy("vec_id").agg(F.min("key").alias("k"), F.max("key").alias("l")).filter("k <> l").select("vec_id")
    same_id = owners.join(several, "vec_id").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    classes = components(found.filter("b is not null").select("a", "b").union(same_id))
    of_key = nodes.select("key", "node", "copies").join(links, "node", "left").join(classes, "node", "left").select("key", F.coalesce("component", "node").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = keyed.select("vec_id", "key").join(of_key, "key", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
