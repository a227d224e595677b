"""The threshold algorithm against scoring every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platwork.llm.topk import threshold_top, top_k


def index(rows):
    return np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)


@pytest.mark.parametrize("n,d,high", [(500, 8, 50), (300, 1, 3), (3, 5, 9), (400, 64, 2), (1, 2, 5)])
def test_threshold_equals_full_scores(n, d, high):
    random = np.random.default_rng(n)
    rows = random.integers(-high, high + 1, (n, d)).astype(float)
    ids = random.permutation(n * 2)[:n]
    for q in [*random.integers(-high, high + 1, (20, d)).astype(float), np.zeros(d)]:
        for skip in (-1, 0):
            best, _ = threshold_top(q, rows, index(rows), ids, skip, 5)
            order = [i for i in np.lexsort((ids, -(rows @ q))) if i != skip][:5]
            assert best == order


def test_reading_stops_early():
    """One row far ahead in the only large dimension: the lists are read to a small depth."""
    rows = np.random.default_rng(0).normal(0, 1, (5000, 3))
    rows[:5, 0] += 1000
    best, depth = threshold_top(np.array([1.0, 0, 0]), rows, index(rows), np.arange(5000), -1, 5)
    assert sorted(best) == [0, 1, 2, 3, 4] and depth < 500


def test_table_with_odd_rows(spark):
    random = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in random.normal(0, 0.2, 6).astype(np.float32)], 7) for i in range(120)]
    vectors += [(50, vectors[50][1], 7), (200, None, 7), (250, [1.0, None] + [0.0] * 4, 7), (300, [float("nan")] * 6, 7), (350, [float("inf")] + [0.0] * 5, 7)]
    vectors += [(None, [1.0] * 6, 7), (400, [0.5, 0.25], 7), (401, [0.5, 0.5], 7), (450, [], 7), (500, [0.0] * 6, 7)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank int")
    got = top_k(table, F.col("vec_id") % 50 == 0, block=32, queries=2).collect()
    whole = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for a, (i, q) in enumerate(whole):
        if i % 50 == 0:
            others = sorted((-int(q @ v), j) for b, (j, v) in enumerate(whole) if b != a and len(v) == len(q))[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(others, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert top_k(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []
