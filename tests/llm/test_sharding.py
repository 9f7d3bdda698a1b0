import zlib

import numpy as np
import pytest

from tidemill.llm.sharding import grown, next_map, op4, read_map, rebalanced, shard, shard_count


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = op4(spark, small).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    loads = np.zeros(8, int)
    for s in range(8):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        loads[s] = sum(r.size for r in own)
    assert loads.max() - loads.min() <= 0.01 * loads.mean() and {r.law for r in out} == {"bytes"}


def test_rebalancing_moves_few_bytes_and_growing_only_into_the_new_shard():
    rng = np.random.default_rng(1)
    weights = rng.integers(1, 2000, 1000)
    first = np.arange(1000) * 5 // 1000
    to = rebalanced(first, weights, 5)
    loads = np.bincount(to, weights, 5)
    assert loads.max() - loads.min() <= 2
    before = np.bincount(first, weights, 5)
    assert weights[to != first].sum() <= 2 * np.maximum(before - before.mean(), 0).sum() + 4000
    more = grown(to, weights, 5)
    assert set(more[more != to]) == {5} and abs(np.bincount(more, weights, 6)[5] - weights.sum() / 6) < 2000


def test_one_slot_heavier_than_all_others():
    weights = np.array([1000, 1, 1, 1, 1, 1, 1, 1])
    loads = np.bincount(rebalanced(np.zeros(8, int), weights, 3), weights, 3)
    assert sorted(loads)[2] == 1000 and sorted(loads)[0] == 3
    assert rebalanced(np.zeros(4, int), np.zeros(4, int), 2).tolist() == [0, 0, 0, 0]


def test_messy_rows_and_versions(spark, messy, empty, tmp_path):
    out = shard(messy, shards=3, slots=16, map_path=str(tmp_path / "map")).collect()
    assert len(out) == messy.count() and all(r.size == 1 and r.text_crc32 == 0 for r in out if r.doc_id == 3)
    assert len({r.virtual_slot for r in out if r.doc_id == 8}) == 1
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    v0, v1 = (read_map(spark, str(tmp_path / "map"), v) for v in (0, 1))
    assert v0.count() == v1.count() == 16
    assert {r.virtual_slot: r.shard for r in v1.collect()}.items() >= {(r.virtual_slot, r.shard) for r in out}
    assert shard(empty).collect() == []


def test_map_is_read_edited_and_stored_as_the_next_version(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, "x" * (i * 37 % 400)) for i in range(600)]
    of = lambda rows, n: {r.virtual_slot: (r.shard, r.map_version) for r in shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=n, slots=64, map_path=path).collect()}
    first, again = of(rows, 4), of(rows, 4)
    assert first == again and {v for _, v in first.values()} == {1}
    more = rows + [(i, "y" * 5_000) for i in range(600, 640)]
    second = of(more, 4)
    assert {v for _, v in second.values()} == {2}
    moved = sum(second[s][0] != first[s][0] for s in first)
    assert 0 < moved < len(first)
    third = of(more, 5)
    changed = {third[s][0] for s in third if third[s][0] != second[s][0]}
    assert changed == {4} and {v for _, v in third.values()} == {3}
    assert {r.virtual_slot: r.shard for r in read_map(spark, path, 1).collect()}.items() >= {(s, x) for s, (x, _) in first.items()}
    with pytest.raises(ValueError):
        of(more, 3)


def test_one_id_on_most_rows_and_equal_rows(spark):
    rows = [(7, f"text {i % 5}") for i in range(400)] + [(None, "same")] * 300 + [(i, "z") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = shard(docs, shards=3, slots=32).collect()
    assert len(out) == len(rows)
    for s in range(3):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))


def test_empty_growth_is_kept(spark, tmp_path):
    """A shard that was added while there were no bytes is there in the next version."""
    path, none = str(tmp_path / "map"), np.zeros(16, np.int64)
    next_map(spark, path, none, 8)
    version, _ = next_map(spark, path, none, 9)
    assert shard_count(spark, path, version) == 9
    with pytest.raises(ValueError):
        next_map(spark, path, none, 8)
    assert set(next_map(spark, path, np.arange(16) + 5, 9)[1]) == set(range(9))
