"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, v a unit vector of the length of a row and u one with an entry per row, each step computes Xv and
X'u by one pass over blocks of rows: u is what is left of Xv after all earlier ones, the next v what is left of X'u. Every
u lies in the span of X's columns and is carried as its coefficients w (u = Xw), so nothing of the number of rows is
stored or shuffled; each pass measures the products of the new Xw with all earlier u, and these are taken out (a second
time if they were large), and the v are orthogonalised twice. Steps go on until the v span the whole space, so that
components of equal deviation are all found; where a step ends early (nothing is left), the next v is a fresh one,
orthogonal to the others. The small bidiagonal matrix is decomposed by the driver.

A pass sends one array of some 2 * length + 1 numbers from each task; they are summed per position by a shuffle. The driver holds
three square matrices of the vectors' length. Passes: one a dimension.

Results: rows whose vector is null, empty, or holds null or non-finite entries are left out. An entry c becomes the integer
floor(scale * c) + shift, with the product held to +-2**62. Vectors of different lengths are fitted apart, each length
with its own n. Components of no variance (under 1e-20 of the whole) are not returned, so equal rows, or a single one, give no
rows. deviation is exact; NULL where it does not fit a long. Rows with equal ids, and equal vectors, each count and are each
returned; a null id is returned as null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import lean_memory, ship, store

LONG = 2**63 - 1
NOTHING = 1e-10  # of the rows' norm: what is left of Xv below it is rounding


def sound(v: Column) -> Column:
    """True for arrays of doubles with an entry at least, all of them finite."""
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("length").to_numpy()
    for length in np.unique(lengths).tolist():
        yield length, batch.filter(pa.array(lengths == length))


def integers(x: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype(np.int64) + shift


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: int64, or Python's integers where these might not fit."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if n * largest < 2**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(gap: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows; None where they do not fit a long."""
    if gap.dtype != object and float(np.abs(gap).max(initial=0)) ** 2 * gap.shape[1] < 2.0**62:
        return (gap * gap).sum(1).tolist()
    return [s if s <= LONG else None for s in (gap.astype(object) ** 2).sum(1).tolist()]


@dataclass(frozen=True)
class Model:
    """Of vectors of one length: their number, sums of integers, components (as columns), variances of these, their sum
    over all dimensions, and the largest entry by which the covariance of whitened rows differs from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whiten(self, gap: np.ndarray) -> np.ndarray:
        return (gap / self.n).astype(np.float64) @ self.components / np.sqrt(self.variances)


def summed(blocks: DataFrame, length: int, per_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of per_block (a flat array of a fixed size) over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        total = None
        for batch in batches:
            for x in batch.column("x"):
                part = per_block(np.frombuffer(x.as_buffer(), np.float64).reshape(-1, length))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    parts = blocks.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("pos", "v"))
    found = parts.groupBy("pos").agg(F.sum("v").alias("v")).collect()
    return np.array([v for _, v in sorted((r.pos, r.v) for r in found)])


def bidiagonalised(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], length: int, norm: float, seed: int = 20_243) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with XV = UB, V square and orthogonal, U of orthogonal columns, B upper bidiagonal. product(w, W): X'Xw,
    (XW)'Xw and the square of |Xw|; norm: of X."""
    rng = np.random.default_rng(seed)
    v_all, w_all, z_all, b = (np.zeros((length, length)) for _ in range(4))  # z: X'u

    def left_of(q: np.ndarray, k: int) -> np.ndarray:
        for _ in range(2):
            q = q - v_all[:, :k] @ (v_all[:, :k].T @ q)
        return q

    v = rng.standard_normal(length)
    v /= np.linalg.norm(v)
    for k in range(length):
        v_all[:, k] = v
        w_before, z_before = w_all[:, :k], z_all[:, :k]
        w = v - w_before @ (z_before.T @ v)
        for _ in range(3):
            xtxw, along, square = product(w, w_before)
            w, xtxw, rest = w - w_before @ along, xtxw - z_before @ along, square - along @ along
            if along @ along <= 1e-6 * square:
                break
        alpha = np.sqrt(max(rest, 0.0))
        if alpha > NOTHING * norm:
            b[k, k], w_all[:, k], z_all[:, k] = alpha, w / alpha, xtxw / alpha
        if k + 1 == length:
            break
        q = left_of(z_all[:, k], k + 1)
        beta = np.linalg.norm(q)
        if beta > 1e-14 * norm:
            b[k, k + 1] = beta
        else:
            q = left_of(rng.standard_normal(length), k + 1)
        v = q / np.linalg.norm(q)
        v = left_of(v, k + 1)
        v /= np.linalg.norm(v)
    return v_all, b


def sound_rows(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, v (array<double>) and length of the rows that take part, as a stored table."""
    v = vectors.select(key, F.col(column).cast("array<double>").alias("v")).filter(sound(F.col("v")))
    return store(v.withColumn("length", F.size("v")), "vectors")


def fit(rows: DataFrame, top: int = 32, scale: float = 64.0, shift: int = 1_000_000, block_bytes: int = 2_000_000) -> dict[int, Model]:
    """Models of rows (v, length), by length, of `top` components at most."""

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for length, part in by_length(batch):
                x = integers(matrix(part.column("v")), scale, shift)
                n, sums = totals.get(length, (0, [0] * length))
                exact = x if np.abs(x).max() < 2**62 // len(x) else x.astype(object)
                totals[length] = n + len(x), [a + int(b) for a, b in zip(sums, exact.sum(0), strict=True)]
        for length, (n, sums) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["length", "dim", "n", "s"])

    found = rows.select("v", "length").mapInArrow(sums_of, "length int, dim int, n long, s decimal(38,0)").groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("length", "dim").collect()
    counts = {r.length: r.n for r in found}
    sums = {length: [int(r.s) for r in found if r.length == length] for length in counts}

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for length, part in by_length(batch):
                n, step = counts[length], max(1, block_bytes // (8 * length))
                for at in range(0, part.num_rows, step):
                    gap = deviations(integers(matrix(part.column("v").slice(at, step)), scale, shift), n, sums[length])
                    yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([np.ascontiguousarray(gap / n, np.float64).tobytes()], pa.binary())], ["length", "x"])

    blocks = store(rows.select("v", "length").mapInArrow(centred, "length int, x binary"), "centred")
    return {length: _fitted(blocks.filter(F.col("length") == length).select("x"), length, counts[length], sums[length], top) for length in sorted(counts)}


def _fitted(blocks: DataFrame, length: int, n: int, sums: list[int], top: int) -> Model:
    square = float(summed(blocks, length, lambda x: np.array([(x * x).sum()]))[0])
    none = Model(n, sums, np.zeros((length, 0)), np.zeros(0), square / n)
    if not square > 0:
        return none

    def product(w: np.ndarray, w_before: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def per_block(x: np.ndarray) -> np.ndarray:
            xw = x @ w
            return np.concatenate([x.T @ xw, (x @ w_before).T @ xw, [xw @ xw]])

        out = summed(blocks, length, per_block)
        return out[:length], out[length:-1], float(out[-1])

    v, b = bidiagonalised(product, length, square**0.5)
    _, values, right = np.linalg.svd(b)
    kept = int((values[:top] > NOTHING * square**0.5).sum())
    components = v @ right[:kept].T
    components = components * np.sign(components[np.abs(components).argmax(0), np.arange(kept)])
    variances = values[:kept] ** 2 / n
    turn = components / np.sqrt(variances)
    mean = summed(blocks, length, lambda x: (x @ turn).sum(0)) / n

    def second(x: np.ndarray) -> np.ndarray:
        y = x @ turn - mean
        return (y.T @ y).ravel()

    error = np.abs(summed(blocks, length, second).reshape(kept, kept) / n - np.eye(kept)).max()
    return Model(n, sums, components, variances, square / n, float(error))


def whitened(rows: DataFrame, models: dict[int, Model], key: str = "vec_id", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """rows (key, v, length) with one row for each component: component (from 1), n, deviation, whitened, explained,
    identity_error."""
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for length, part in by_length(batch):
                m = models[length]
                k = len(m.variances)
                if not k:
                    continue
                gap = deviations(integers(matrix(part.column("v")), scale, shift), m.n, m.sums)
                rows, row = len(gap), pa.array(np.repeat(np.arange(len(gap)), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n, np.int64)), pa.array(squares(gap), pa.int64()).take(row),
                     pa.array(m.whiten(gap).ravel()), pa.array(np.tile(m.variances / m.trace, rows)), pa.array(np.full(rows * k, m.identity_error))],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(key, "v", "length").mapInArrow(run, f"{key} {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, top: int = 32, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    ship(vectors.sparkSession)
    rows = sound_rows(vectors, column, key)
    return whitened(rows, fit(rows, top), key)


def op13(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
