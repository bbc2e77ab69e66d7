"""Exact top-k products against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchspark.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score string"
LAST = 2**63 - 1


def brute(rows, k=5, every=50):
    """Sorted (query, rank, vec_id, score) by Python integers."""
    good = [(LAST if i is None else i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i == LAST or i % every:
            continue
        scores = sorted((-min(max(sum(x * y for x, y in zip(q, p, strict=True)), -(2**63)), 2**63 - 1), j) for b, (j, p) in enumerate(good) if a != b and len(p) == len(q))
        out += [(i, n + 1, None if j == LAST else j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in topk.top_products(df, F.col("vec_id") % 50 == 0, **more).collect()), key=str)


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_topk_equals_all_products(spark, spread):
    """Lengths alike and lengths far apart; clusters, copies, and many buckets."""
    r = np.random.default_rng(int(spread) + 3)
    centres = r.normal(size=(12, 16))
    x = centres[r.integers(0, 12, 900)] + 0.05 * r.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(spread * r.normal(size=(900, 1)))
    x[100:400] = x[0]  # a third of the rows are copies
    x[500:520] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows, bucket_numbers=16 * 64) == brute(rows)


def test_topk_odd_rows(spark):
    v = [0.5, -0.25]
    rows = [(0, v), (0, v), (0, [1.0, 1.0]), (50, None), (100, [None, 1.0]), (150, [float("nan"), 0.0]), (None, v), (None, [9.0, 9.0]), (7, [0.0, 0.0]), (200, [1e300, 1.0]), (250, [3e15, -3e15]),
            (251, [7e14, 1e15]), (300, [1.0]), (350, []), (351, []), (8, [-1.0, 2.0]), (-50, [0.001, -0.001])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == [] and found(spark, []) == []


def test_both_prunings_are_used():
    """Near queries are answered by a coordinate's range, far ones by the rows that are long enough; neither loses a row."""
    r = np.random.default_rng(5)
    p = r.normal(size=(4000, 8))
    p[:40] = p[0] + 0.01 * r.normal(size=(40, 8))
    p *= np.where(np.arange(4000) < 3000, 1000, 300)[:, None] / np.linalg.norm(p, axis=1, keepdims=True)
    p = np.floor(p)
    bucket = topk.Bucket(np.arange(4000), p, np.linalg.norm(p, axis=1))
    q = np.floor(p[:40] + r.normal(size=(40, 8)))
    size = np.linalg.norm(q, axis=1)
    truth = q @ p.T
    for rank in (5, 400):
        least = np.sort(truth, axis=1)[:, -rank]
        of, place, score = bucket.best(np.full(40, -1), q, size, least, 5)
        want = [sorted(((-s, i) for i, s in enumerate(row)))[:5] for row in truth]
        got = [sorted((-s, int(bucket.ids[j])) for a, j, s in zip(of, place, score, strict=True) if a == i) for i in range(40)]
        assert got == [[(int(s), i) for s, i in w] for w in want]
    cosine = np.sort(truth, axis=1)[:, -5] / size / bucket.size[0]
    assert bucket.axes and (bucket.long_enough(size, np.sort(truth, axis=1)[:, -5]) < 4000).any() and cosine.max() > topk.STEEP
