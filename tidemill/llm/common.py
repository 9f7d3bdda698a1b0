"""What the operators share: intermediate tables, shipping of the package, grouped Arrow blocks."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.upsert import shared_dir

_ROOT = Path(__file__).resolve().parents[2]


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, and keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")
    sc = spark.sparkContext
    if getattr(sc, "_tidemill_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="tidemill-ship-")) / "tidemill_pkg.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((_ROOT / "tidemill").rglob("*.py")):
            z.write(p, os.path.relpath(p, _ROOT))
    sc.addPyFile(str(at))
    sc._tidemill_shipped = True


_lean: list[bool] = []


def lean_memory() -> None:
    """In a Python worker: give freed arrays back to the system at once. Workers live as long as their executor, and
    the C library would keep what the largest batch took."""
    if _lean:
        return
    _lean.append(True)
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-8, 2)  # M_ARENA_MAX
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces whose text has about max_bytes; a longer row travels alone."""
    lean_memory()
    if batch.num_rows == 0:
        return
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + max_bytes, "right"))
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1_500, max_bytes: int = 600_000) -> Iterator[pa.Table]:
    """From batches sorted by keys: tables of whole groups, cut as soon as they reach `rows` rows or max_bytes."""
    lean_memory()
    kept: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n < rows and size < max_bytes:
            continue
        t = pa.Table.from_batches(kept)
        differs = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            differs |= v[1:] != v[:-1]
        cuts = np.flatnonzero(differs)
        if not len(cuts):
            continue
        at = int(cuts[-1]) + 1
        yield t.slice(0, at)
        rest = t.slice(at).combine_chunks()
        kept, n, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if kept:
        yield pa.Table.from_batches(kept)


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Start of every group of equal adjacent keys, and the end of the last."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def crc_long(column) -> "F.Column":
    """Unsigned CRC-32 of a string's UTF-8 bytes."""
    return F.crc32(F.encode(column, "UTF-8"))
