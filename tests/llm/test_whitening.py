"""Whitening against numpy's eigenvectors, and rows that are left out."""

import numpy as np

from tests.conftest import DATA
from tidemill.llm import whitening


def told(rows: list[list[float]], top: int = 32):
    """(n, deviations, explained, components, variances, centred) by a plain eigendecomposition."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in r] for r in rows], object)
    n, s = len(x), x.sum(0)
    gap = n * x - s
    centred = (gap / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, (gap**2).sum(1).tolist(), values[::-1][:top] / values.sum(), vectors[:, ::-1][:, :top], values[::-1][:top], centred


def compare(got, rows, top=32):
    n, deviations, explained, components, values, centred = told(rows, top)
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    k = len(got) // len(rows)
    assert [r.deviation for r in got[::k]] == deviations and {r.n for r in got} == {n}
    w = np.array([r.whitened for r in got]).reshape(len(rows), k)
    want = centred @ components[:, :k] / np.sqrt(values[:k])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-8
    assert np.abs(np.array([r.explained for r in got[:k]]) / explained[:k] - 1).max() < 1e-10
    assert got[0].identity_error < 1e-10 and len({r.identity_error for r in got}) == 1
    assert [r.component for r in got[:k]] == list(range(1, k + 1))
    return k


def test_query(spark):
    path = f"{DATA}/sf0.001"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    assert compare(whitening.op13(spark, path).collect(), [r.embedding for r in rows]) == 32


def test_equal_deviations_and_few_dimensions(spark):
    """Components of one variance are all found, and dimensions without any give none."""
    rng = np.random.default_rng(1)
    corners = [[a, b, c, 0.5, d] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1) for d in (-3, 3)]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(corners)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and max(r.identity_error for r in got) < 1e-10
    shares = {r.component: r.explained for r in got}
    assert np.allclose([shares[k] for k in (1, 2, 3, 4)], [0.75, 1 / 12, 1 / 12, 1 / 12])
    skewed = (rng.standard_normal((300, 7)) * [100, 30, 10, 3, 1, 0.3, 0.1]).tolist()
    df = spark.createDataFrame([(i, r) for i, r in enumerate(skewed)], "vec_id long, embedding array<double>").repartition(5)
    assert compare(whitening.whiten(df, top=3).collect(), skewed, 3) == 3


def test_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.9], [0.4, -2.0], [0.4, -2.0], [-1.0, 3.0]]
    rows = [*((i, v, 7) for i, v in enumerate(good)), (4, None, 1), (5, [], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [3.0], 1), (9, [5.0], 1), (10, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    out = whitening.whiten(df).collect()
    assert compare([r for r in out if r.vec_id < 4], good) == 2
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in out if r.vec_id > 3) == [(9, 1, 2, 16384), (9, 1, 2, 16384)]  # a length of its own
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(None, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")).filter("vec_id is null").count() == 1
    large = [[1e300, 0.0], [1e15, 1.0], [-1e15, 2.0]]
    out = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(large)], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in out} == {None} and {r.vec_id for r in out} == {0, 1, 2}
