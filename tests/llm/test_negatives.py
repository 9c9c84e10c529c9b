"""Hard negatives against all inner products, and the bounds of the tree."""

import math
import random

import numpy as np
import pytest

from corvane.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, v string, id string, rank int"


def brute(rows, every=3, k=5):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if i is not None and l is not None and v and None not in v and all(map(math.isfinite, v))]
    widths = [len(v) for *_, v in good]
    width = min(set(widths), key=lambda n: (-widths.count(n), n), default=0)
    good = [(i, l, v) for i, l, v in good if len(v) == width and sum(x * x for x in v) <= 1 << 62]
    anchors = {}
    for i, l, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, l) for i, l, v in good if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fits = [(n, -t) for t, n, l in scored if l != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r, n, -s, t) for r, (n, t) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, parts=5, **options):
    df = spark.createDataFrame([(i, v, l, "x", "y", 0) for i, v, l in rows], SCHEMA).repartition(parts)
    found = negatives.mine(df, lambda i: i % 3 == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def clustered(n, width=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    return [(i, (centres[i % 8] + rng.normal(size=width) * 0.2).round(2).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 6)
    rows = clustered(140)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, fit_rows=20, block_bytes=8 * 6 * 4) == brute(rows)  # a leaf in many blocks
    monkeypatch.setattr(negatives, "LISTED", 3)  # counts by label don't fit
    assert run(spark, rows, fit_rows=30) == brute(rows)


def test_ties_repeated_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, float(i % 2)], i % 3) for i in range(60)]  # large groups of equal vectors
    rows += [(100, [0.0, 0.0, 0.0], 1), (102, [0.0, 0.0, 0.0], 1), (103, [0.0, -0.0, 0.0], 2), (105, [-1.0, 0.0, -1.0], 0)]
    rows += [(3, [1.0, 0.0, 1.0], 0)] * 9 + [(3, [0.5, 0.5, 0.5], 2), (4, [1.0, 0.0, 0.0], 1)]  # rows of one id
    rows += [(None, [1.0, 0.0, 0.0], 0), (200, None, 0), (201, [], 0), (202, [nan, 0.0, 0.0], 0), (203, [inf, 0.0, 0.0], 0), (204, [None, 0.0, 0.0], 0), (205, [1.0, 1.0], 0), (206, [1.0, 0.0, 0.0], None)]
    assert run(spark, rows) == brute(rows)


def test_large_numbers_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 4)
    random.seed(6)
    rows = [(i, [random.choice([3e6, 3e6 + 1 / 256, 2.9e6]), random.choice([2e6, 2e6 + 1 / 256])], i % 2) for i in range(40)] + [(99, [1e300, 1.0], 0), (96, [4e7, 0.0], 1)]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 0)]) == []
    assert run(spark, [(0, [1.0], 0), (1, [1.0], 1)]) == []  # no positive
    assert run(spark, [(0, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1)], parts=1) == [(0, 1, 1, 2, 65536, 58880)]


def test_bounds_hold(spark):
    x = negatives.augmented(np.array([v for _, v, _ in clustered(400)]), 50.0)
    tree = negatives.fit(x, 10)
    leaf, ways = tree.assign(x)
    n = int(tree.leaf.max()) + 1
    low, high = (np.array([f(ways[leaf == i], axis=0) for i in range(n)]) for f in (np.min, np.max))
    tree = tree.measured(np.nan_to_num(low), np.nan_to_num(high), np.bincount(leaf, minlength=n))
    q = np.r_[x[7, :-1], 0.0]
    d = negatives.distances(x, q)
    walked = list(tree.walk(q))
    assert sorted(b for b, *_ in walked) == list(range(n)) and n > 20
    assert [near for _, near, _ in walked] == sorted(near for _, near, _ in walked)
    for b, near, far in walked:
        assert near - 1e-9 <= d[leaf == b].min() and d[leaf == b].max() <= far + 1e-9
    inner, outer = np.quantile(d, [0.02, 0.1])
    met = {b for b, *_ in tree.walk(q, inner, outer)}
    assert set(leaf[(d >= inner) & (d <= outer)].tolist()) <= met and len(met) < n  # the annulus leaves some out


@pytest.mark.parametrize("score", [-101, -100, -1, 0, 1, 99, 100, 12345, (1 << 62) - 1, -(1 << 62)])
def test_hundredths(spark, score):
    from pyspark.sql import functions as F

    s = F.lit(score).cast("long")
    got = spark.range(1).select(negatives._hundredths(s, 80, True), negatives._hundredths(s, 100, False)).first()
    assert (got[0], got[1]) == (-(-80 * score // 100), score)
