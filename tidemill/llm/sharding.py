"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its doc_id (of its text where that is null) modulo `slots`, and never changes. Only the
map from slots to shards does. Version 0 deals slots out in even ranges; rebalancing reads the bytes per slot and writes the
next version, moving slots from shards over the mean to shards under it, as few bytes as it takes, until no move and
no swap brings the largest and smallest shard closer. Growing by a shard moves slots only into the new one.

Only the byte count per slot (`slots` numbers, at most MOST_SLOTS) reaches the driver. Maps are stored as Parquet,
one folder per version; a version is never rewritten. Given the folder of a map, the latest version is read, edited and
stored as the next one; if nothing moves, it stays. More shards than the map has are added one by one, each of which
only takes slots; fewer are refused.

Rows are numbered within their slot in PARTS parts, so that a slot of any size is spread. Null texts have no bytes. Rows
with equal doc_id share a slot; rows with equal text need not. Ties and repeated rows are numbered in any, but one, order.
Very long texts only count by their bytes. Extra columns are ignored. An empty table has a map as well.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import crc_long, shared_dir, store

MOST_SLOTS = 1 << 16
PARTS = 16


def sized(docs: DataFrame, slots: int) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, virtual_slot."""
    if not 0 < slots <= MOST_SLOTS:
        raise ValueError(f"slots must be from 1 to {MOST_SLOTS}")
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id"))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc_long(text).alias("text_crc32"), F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(sizes: DataFrame, slots: int) -> np.ndarray:
    out = np.zeros(slots, np.int64)
    for r in sizes.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():  # at most `slots` rows
        out[r.virtual_slot] = r.bytes
    return out


def rebalanced(shards_of: np.ndarray, weights: np.ndarray, shards: int) -> np.ndarray:
    """The next map: moves of slots from the fullest to the emptiest shard, or swaps between the two, while that brings
    them closer. A shard that cannot give (one heavy slot, say) is left alone and the next fullest gives."""
    to = shards_of.copy()
    load = np.bincount(to, weights, shards).astype(np.int64)
    gives = np.ones(shards, bool)
    for _ in range(20 * len(to)):
        high, low = int(np.where(gives, load, -1).argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        if gap <= 1 or not gives.any():
            break
        own = np.flatnonzero((to == high) & (weights > 0))
        other = np.flatnonzero(to == low)
        other = other[np.argsort(weights[other], kind="stable")]
        left = np.abs(gap - 2 * weights[own])  # the gap that moving each would leave
        i = int(left.argmin()) if len(own) else -1
        move = int(left[i]) if len(own) else gap
        swap = gap
        if move > gap // 2 and len(own) and len(other):
            j = np.clip(np.searchsorted(weights[other], weights[own] - gap // 2), 0, len(other) - 1)
            after = np.abs(gap - 2 * (weights[own] - weights[other[j]]))
            k = int(after.argmin())
            swap = int(after[k])
        if min(move, swap) >= gap:
            gives[high] = False
            continue
        if swap < move:
            x, y = own[k], other[j[k]]
            to[x], to[y] = low, high
            moved = weights[x] - weights[y]
        else:
            to[own[i]] = low
            moved = weights[own[i]]
        load[high] -= moved
        load[low] += moved
    return to


def grown(shards_of: np.ndarray, weights: np.ndarray, shards: int) -> np.ndarray:
    """A map with one more shard, which takes slots from the fullest shards and gives none."""
    to = shards_of.copy()
    load = np.bincount(to, weights, shards + 1).astype(np.int64)
    goal = load.sum() // (shards + 1)
    while load[shards] < goal:
        high = int(load[:shards].argmax())
        own = np.flatnonzero((to == high) & (weights > 0) & (weights <= goal - load[shards] + 1))
        if not len(own):
            break
        best = own[weights[own].argmax()]
        to[best] = shards
        load[high] -= weights[best]
        load[shards] += weights[best]
    return to


def write_map(spark: SparkSession, path: str, version: int, shards_of: np.ndarray, shards: int | None = None) -> None:
    """Store one version (an error if it is there), with the number of shards, some of which may hold no slot."""
    shards = shards or int(shards_of.max()) + 1
    rows = spark.createDataFrame([(s, int(x), shards) for s, x in enumerate(shards_of)], "virtual_slot int, shard int, shards int")
    rows.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("version int, virtual_slot int, shard int").parquet(path).filter(F.col("version") == version)


def latest_map(spark: SparkSession, path: str) -> tuple[int, np.ndarray] | None:
    """The latest version and the shard of each slot; None where there is no map."""
    try:
        version = spark.read.schema("version int, virtual_slot int, shard int").parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = read_map(spark, path, version).orderBy("virtual_slot").collect()  # one for each slot
    return version, np.array([r.shard for r in rows], np.int64)


def shard_count(spark: SparkSession, path: str, version: int) -> int:
    """The number of shards of a version."""
    rows = spark.read.schema("version int, shard int, shards int").parquet(path).filter(F.col("version") == version)
    return rows.agg(F.coalesce(F.max("shards"), F.max("shard") + 1).alias("n")).first().n


def next_map(spark: SparkSession, path: str, weights: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """The map at path edited for the bytes per slot and the number of shards; what it gives is stored as well."""
    slots = len(weights)
    found = latest_map(spark, path)
    if found is None:
        found = 0, np.arange(slots) * shards // slots
        write_map(spark, path, *found, shards)
    version, now = found
    have = shard_count(spark, path, version)
    if len(now) != slots or have > shards:
        raise ValueError(f"the map has {len(now)} slots on {have} shards")
    to = rebalanced(now, weights, shards) if have == shards else now
    for more in range(have, shards):
        to = grown(to, weights, more)
    if version and have == shards and (to == now).all():
        return version, now
    write_map(spark, path, version + 1, to, shards)
    return version + 1, to


def shard(docs: DataFrame, shards: int = 8, slots: int = 4096, map_path: str | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (its place in the shard, from 0), virtual_slot, map_version.

    map_path: where the map's versions are; a new folder in the shared one if not given."""
    spark = docs.sparkSession
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")  # stored with its row before it is used
    sizes = store(sized(docs, slots).withColumn("part", part), "sizes")
    path = map_path or f"{shared_dir(spark)}/tidemill/slot-map-{uuid.uuid4().hex}"
    version, to = next_map(spark, path, slot_bytes(sizes, slots), shards)
    slot_map = spark.createDataFrame([(s, int(x)) for s, x in enumerate(to)], "virtual_slot int, shard int")
    counts = sizes.groupBy("virtual_slot", "part").count().join(F.broadcast(slot_map), "virtual_slot")  # at most slots * PARTS rows
    before = counts.select("virtual_slot", "part", "shard", (F.sum("count").over(W.partitionBy("shard").orderBy("virtual_slot", "part")) - F.col("count")).alias("before"))
    place = F.row_number().over(W.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    out = sizes.withColumn("place", place).join(F.broadcast(before), ["virtual_slot", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), "virtual_slot", F.lit(version).alias("map_version"))


def op4(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
