"""Hard negatives against a plain search over all rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, score double, row int"


def plain(rows, positives=5, negatives=3):
    sound = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, label, v) in enumerate(sound):
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for n, (j, m, w) in enumerate(sound) if n != k and len(w) == len(v)]
        for s, p, _ in sorted((x for x in scored if x[2] == label), key=lambda x: x[:2])[:positives]:
            fits = sorted((x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s), key=lambda x: x[:2])[:negatives]
            out += [(i, p, r, q, -s, -t) for r, (t, q, _) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, **options)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_against_all_rows(spark):
    """Several chunks, ranges and blocks, ties by copies, a label with a third of the rows."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((260, 12)) + 0.4
    rows = [(i, int(min(rng.integers(0, 6), 3)), (base[i % 260 if i % 9 else 0] + 0.02 * (i % 3)).tolist(), 0.0, 0) for i in range(700)]
    want = plain(rows)
    assert len(want) > 60
    assert found(spark, rows, chunk=3, block_rows=40, run=2) == want
    assert found(spark, rows) == want


def test_messy_rows(spark):
    nan = float("nan")
    rows = [
        (0, 1, [1.0, 0.5], 0.0, 1), (0, 1, [1.0, 0.4], 0.0, 1), (1, 1, [0.9, 0.4], 0.0, 1), (2, 2, [0.5, 0.5], 0.0, 1), (2, 2, [0.5, 0.5], 0.0, 1), (3, 2, [0.6, 0.1], 0.0, 1), (4, 3, [-1.0, -1.0], 0.0, 1),
        (5, None, [1.0, 1.0], 0.0, 1), (None, 1, [1.0, 1.0], 0.0, 1), (6, 1, None, 0.0, 1), (7, 1, [], 0.0, 1), (8, 1, [1.0, None], 0.0, 1), (9, 2, [nan, 1.0], 0.0, 1), (10, 2, [float("inf"), 1.0], 0.0, 1), (50, 4, [0.3], 0.0, 1), (11, 4, [0.2], 0.0, 1), (12, 5, [0.11], 0.0, 1), (100, 9, [1.0, 1.0], 0.0, 1),
    ]
    want = plain(rows)
    assert found(spark, rows) == want and {r[0] for r in want} == {0, 50}
    assert found(spark, []) == []


def test_large_numbers(spark):
    """Products beyond what doubles hold exactly."""
    rows = [(0, 1, [3.0e6 + 1, 2.0e6], 0.0, 1), (1, 1, [3.0e6, 1.0e6 + 3], 0.0, 1), (2, 1, [3.0e6, 1.0e6 + 2], 0.0, 1), *((k, 2, [2.0e6, 1.0e6 + k / 256], 0.0, 1) for k in range(3, 9))]
    assert found(spark, rows) == plain(rows) != []
    far = found(spark, [(0, 1, [1e200], 0.0, 1), (1, 1, [1e200], 0.0, 1), (2, 2, [9e199], 0.0, 1)])
    assert far == []  # both scores count as the largest long
