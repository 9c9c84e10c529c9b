"""Points of several vectors through lists with bounds, against all cosines in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.embed import HashEmbedder
from corvane.operators import retriever as rt
from corvane.sources.collection import Collection
from corvane.sources.late_index import LateIndex

WIDTH, POINTS, EACH = 12, 700, 4


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(25, WIDTH)) * 3
    x = (centres[rng.integers(0, 25, (POINTS, EACH))] + rng.normal(size=(POINTS, EACH, WIDTH)) * 0.4).reshape(-1, WIDTH)
    rows = [(i // EACH, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * WIDTH), (9003, [1.0] * 3), (9004, [float("nan")] * WIDTH), (9005, [None, *[1.0] * (WIDTH - 1)]), (0, [0.0] * WIDTH), (None, [1.0] * WIDTH)]
    df = spark.createDataFrame(rows + odd, "id long, vec array<double>").repartition(3)
    return x, LateIndex.build(df, str(tmp_path_factory.mktemp("late") / "i"), lists=30)


def best(x, q, k, keep=lambda i: True):
    s = (x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))).reshape(-1, EACH).max(1).round(6)
    return sorted(((i, float(v)) for i, v in enumerate(s) if keep(i)), key=lambda r: (-r[1], r[0]))[:k]


def rows(df):
    return [(r["id"], r["score"]) for r in df.collect()]


@pytest.mark.parametrize("seed, k", [(0, 1), (1, 10), (2, 60)])
def test_equal_to_all_cosines(held, seed, k):
    x, index = held
    q = np.random.default_rng(seed).normal(size=WIDTH)
    for query in (q, x[seed * 7]):
        assert rows(index.search(query.tolist(), k)) == best(x, query, k)


def test_filtered_and_more_than_there_are(spark, held):
    x, index = held
    some = spark.range(0, POINTS, 9)
    assert rows(index.search(x[3].tolist(), 20, some)) == best(x, x[3], 20, lambda i: i % 9 == 0)
    assert rows(index.search(x[3].tolist(), 5000, some)) == best(x, x[3], 5000, lambda i: i % 9 == 0)
    assert index.search(x[3].tolist(), 5, some.limit(0)).collect() == []


def test_fewer_vectors_are_read(held):
    x, index = held
    q = x[11] / np.linalg.norm(x[11])
    least = index._least(q, 10, None)
    left = index.may_reach(q, least)
    assert sum(index.lists[b][0] for b in left) < len(x) / 3
    scored = index._best(q, left, least, None)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert scored.count() < POINTS / 2


def test_queries_without_a_direction(held):
    _, index = held
    for q in ([0.0] * WIDTH, [1.0] * 3, [float("nan")] * WIDTH):
        assert index.search(q, 3).collect() == []


def test_empty(spark, tmp_path):
    index = LateIndex.build(spark.createDataFrame([], "id long, vec array<double>"), str(tmp_path / "i"))
    assert index.search([1.0], 3).collect() == []


def test_in_a_collection(spark, tmp_path):
    """After upserts beside the index and after compaction: as without an index, filtered too."""
    e, schema = HashEmbedder(16), "n long, content string, role string, queries array<string>"
    text = lambda i: (i, f"text {i}", "xy"[i % 2], [f"how {i} do", f"why w{i % 7}"] if i % 3 else [])
    c = Collection.create("c", str(tmp_path / "c"), spark.createDataFrame([text(i) for i in range(80)], schema), e, key="n").index_queries(lists=5)
    c = c.upsert(spark.createDataFrame([(4, "how w1", "x", []), (90, "why w1", "y", ["why why w1"])], schema), e, removed=[10, 1])
    for held in (c, c.compact()):
        assert "late" in held.about
        plain, through = (rt.Retriever({"c": held}, e, code="c", vector_index=v) for v in (False, True))
        for filters in (None, {"role": "x"}):
            got = [x.search("why w1", limit=15, filters=filters, vector_name="queries").select("id", F.round("score", 6).alias("s")).collect() for x in (plain, through)]
            assert got[0] == got[1] and len(got[0]) == 15
