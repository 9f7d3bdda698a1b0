from collections import Counter

import numpy as np
import pyarrow as pa

from tidemill.llm.embedding_dedup import Space, _deal, link_vectors, op9


def brute(rows, cosine=0.9):
    rows = sorted(rows)
    x = np.array([v for _, v in rows], np.float64)
    n = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / np.outer(n, n) >= cosine - 1e-12
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    return {rows[i][0]: (int(near[i].sum()), rows[root[i]][0]) for i in range(len(rows))}


def test_query_against_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    out = op9(spark, small).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(rows) and all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_clusters_copies_and_chunks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 12] + 0.25 * rng.normal(size=24)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    assert max(n for n, _ in want.values()) > 40
    for options in ({}, {"chunk": 20, "slabs": 3, "blocks": 5}):
        assert {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(df, **options).collect()} == want


def test_unsound_vectors_and_shared_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (2, a), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, []), (9, [1.0, 0.0]), (10, b), (11, a), (11, b), (None, a)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node int, key int")
    out = link_vectors(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id != 11}
    assert got == {1: (2, 1), 2: (2, 1), 10: (1, 1), None: (0, None)} | {i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert {r.component_id for r in out if r.vec_id == 11} == {1}
    assert link_vectors(df.limit(0)).collect() == []


def test_groups_are_bounded_by_the_chunk():
    rng = np.random.default_rng(3)
    n, chunk, space = 4_000, 100, {16: Space(16, 0.9, 4, 8)}
    v = pa.array(rng.normal(size=(n, 16)).tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([1] * n, pa.int64()), v, pa.array([16] * n, pa.int32())], ["node", "copies", "v", "length"])
    counts = pa.Table.from_batches(_deal(space, None)([batch])).to_pylist()
    chunks = {tuple(r[k] for k in r if k != "n"): -(-r["n"] // chunk) for r in counts}
    sizes = Counter()
    for b in _deal(space, chunks)([batch]):
        sizes.update(zip(*(b.column(c).to_pylist() for c in b.schema.names if c not in ("home", "node", "copies", "v")), strict=True))
    assert max(sizes.values()) < 3 * chunk


def test_any_magnitude(spark):
    """Finite vectors of cosine 1 link, whatever over- or underflows in their squares."""
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [1.0, 0.0]), (6, [1.7e308, 1.0]), (7, [5e-324, 0.0]), (8, [0.0, 3e307]), (9, [3e-320, 1e-320])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (7, 1) for i in (1, 2, 3, 4, 5, 6, 7, 9)}, 8: (0, 8)}
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_rows_dealt_do_not_grow_with_the_chunks():
    rng = np.random.default_rng(5)
    n, space = 2_000, {16: Space(16, 0.9, 4, 8)}
    v = pa.array(rng.normal(size=(n, 16)).tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array([7] * n, pa.int64()), pa.array([1] * n, pa.int64()), v, pa.array([16] * n, pa.int32())], ["node", "copies", "v", "length"])
    counts = pa.Table.from_batches(_deal(space, None)([batch])).to_pylist()
    for chunk in (1_000, 20):
        chunks = {tuple(r[k] for k in r if k != "n"): -(-r["n"] // chunk) for r in counts}
        assert sum(b.num_rows for b in _deal(space, chunks)([batch])) == n


def test_copies_that_all_link(spark):
    """Every pair of a large group, over several chunks and with candidates in several blocks, counts once."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in np.ones(8) + 0.01 * rng.normal(size=8)]) for i in range(700)] + [(700 + i, [float(v) for v in rng.normal(size=8) * [1, -1, 1, -1, 1, -1, 1, -1]]) for i in range(50)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), chunk=150).collect()}
    assert got == brute(rows) and got[0][0] >= 699
