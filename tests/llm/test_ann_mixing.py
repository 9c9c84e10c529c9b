"""Neighbour search against all distances; mixing against its targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, mixing


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 16))
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.3, (3000, 16))
    x[500:1500] = x[7]  # a third are copies
    return x


def test_recall_and_exact_scores(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, score int").repartition(4)
    rows = ann.search(df, lambda i: i % 100 == 0).collect()
    ids = np.arange(len(vectors))
    hits = 0
    for q in range(0, 3000, 100):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [r for r, *_ in own] == list(range(1, 11))
        assert own == sorted(own, key=lambda r: (r[2], r[1]))
        for _, v, s in own:
            assert s == pytest.approx(float(np.sqrt(((vectors[v] - vectors[q]) ** 2).sum())), abs=1e-12)
        _, want, _ = ann.nearest(vectors[[q]], np.array([q]), vectors, ids, 10)
        hits += len({v for _, v, _ in own} & set(want.tolist()))
        if 500 <= q < 1500:  # ties go to smaller ids
            assert [v for _, v, _ in own] == [i for i in [7, *range(500, 515)] if i != q][:10]
    assert hits >= 0.9 * 10 * 30


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (9, [2.0, 0.0]), (0, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, lambda i: i == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 9, 1.0)]  # one query by the first vector of vec_id 0
    assert ann.search(df.limit(0), lambda i: i == 0).collect() == []
    assert ann.search(df.filter("vec_id = 1"), lambda i: i == 1).collect() == []


def test_repeated_rows_lose_no_neighbour(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame([*rows, rows[0], rows[3], (0, [-5.0, 1.0])], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, lambda i: i == 0).collect())
    assert got == [(1, 1, 6.0), (2, 2, 7.0), (3, 3, 8.0), (4, 3, 8.0), *((n + 5, n + 4, n + 9.0) for n in range(6))]


def test_huge_distances(spark):
    df = spark.createDataFrame([(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1e200, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, lambda i: i < 2).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 2e200), (1, 1, 0, 2e200), (1, 2, 2, 2e200)]


def test_distances_at_the_ends_of_doubles():
    x = np.array([[1e-200, 0.0], [3e-200, 4e-200], [0.0, 0.0], [3e250, 4e250], [1.5e308, 0.0], [3.0, 4.0]])
    assert ann.distances(x, np.zeros(2)).tolist() == pytest.approx([1e-200, 5e-200, 0.0, 5e250, 1.5e308, 5.0], rel=1e-15)
    assert ann.distances(x[4:5], np.array([-1.5e308, 0.0])).tolist() == [float("inf")]


def test_sample_is_bounded_in_bytes(spark, vectors, monkeypatch):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    seen, fit = [], ann.fit
    monkeypatch.setattr(ann, "FIT_BYTES", 100 * 8 * vectors.shape[1])
    monkeypatch.setattr(ann, "fit", lambda x: seen.append(len(x)) or fit(x))
    assert ann.search(df, lambda i: i % 20 == 0).count() == 10 * len(range(0, len(vectors), 20))
    assert seen == [100]


def test_blocks_bound_a_task(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.search(df, lambda i: i % 20 == 0).collect()))
    small = ann.search(df, lambda i: i % 20 == 0, block_bytes=16 * 8 * 50)  # 50 vectors
    assert sorted(map(tuple, small.collect())) == whole
    hot = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 7 + 1).cast("int").alias("leaf"), "id", F.array(F.col("id").cast("double")).alias("v"))
    dealt, asked = ann.deal(hot, hot.filter("id % 5 = 0"), 50)
    for side in (dealt, asked):
        assert side.groupBy("leaf", "a", "b").count().agg(F.max("count")).first()[0] < 100
    met = dealt.filter("leaf = 0").select("id", "a", "b").join(asked.filter("leaf = 0").select(F.col("id").alias("q"), "a", "b"), ["a", "b"])
    assert met.count() == met.select("id", "q").distinct().count() == 3000 * 600


def test_walk_goes_on_for_enough_candidates(vectors):
    tree = ann.fit(vectors)
    held = np.ones(tree.leaves, int)
    assert len(tree.visit(vectors[0], 1, held, 11)) == 11
    assert len(tree.visit(vectors[0], 1, held, 10**6)) == tree.leaves
    assert len(tree.visit(vectors[0], 3, held * 100, 11)) == 3


def test_walk_visits_every_leaf_once(vectors):
    tree = ann.fit(vectors)
    assert sorted(tree.visit(vectors[0], tree.leaves)) == list(range(tree.leaves))
    assert tree.leaves > 10
    assert set(tree.assign(vectors)) <= set(range(tree.leaves))


LANGS = {"en": ["the", "and", "of"], "de": ["der", "und", "von"]}


@pytest.fixture(scope="module")
def mixture(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(LANGS["en" if i % 5 else "de"], 30)), "en" if i % 5 else "de", 9) for i in range(300)]
    docs += [(1000, None, "en", 0), (1001, "", None, 0), (None, "the and", "en", 0), (1, docs[1][1], "en", 9)]
    labels = [(i, 1) for i in range(0, 300, 2)] + [(7, None), (None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, rate int"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_expected_totals_meet_targets(mixture):
    docs, labels = mixture
    rows = mixing.rates(docs, labels, {"en": 0.5, "de": 0.5}).collect()
    assert len(rows) == docs.count()
    totals = np.array([[r["tokens"] * r["rate"] * p for p in r["posterior"]] for r in rows]).sum(0)
    assert totals[0] == pytest.approx(totals[1], rel=1e-3)
    assert all(r["rate"] >= 0 and r["copies"] >= 1 for r in rows)
    right = [r["domain"] == ("en" if r["doc_id"] % 5 else "de") for r in rows if r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(right) == len(right)


def test_rates_stay_nonnegative(mixture):
    docs, labels = mixture
    rows = mixing.rates(docs, labels, {"en": 0.001, "de": 0.999}, total=1000.0).collect()
    assert min(r["rate"] for r in rows) >= 0
    en = sum(r["tokens"] * r["rate"] * r["posterior"][0] for r in rows)
    assert en < 50


def test_mix_columns_and_odd_tables(mixture):
    docs, labels = mixture
    got = mixing.mix(docs, labels, {"en": 0.5, "de": 0.5, "xx": 0.3})
    assert got.columns == ["doc_id", "text", "lang", "domain", "tokens", "rate", "copies"]
    assert got.count() == docs.count()
    assert {r["rate"] for r in mixing.mix(docs, labels.limit(0)).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("clean, targets, met", [([1.0, 0.0], [0.5, 0.5], True), ([0.9, 0.1], [0.5, 0.5], True), ([0.6, 0.4], [0.05, 0.95], False)])
def test_overlapping_domains_lose_no_document(spark, clean, targets, met):
    rows = [(100, clean)] * 40 + [(100, [0.8, 0.2])] * 10 + [(50, [0.1, 0.9])] * 40
    members = spark.createDataFrame(rows, "tokens long, posterior array<double>")
    rate, now, goal = mixing.fit_rates(members, targets)
    got = members.select("tokens", "posterior", rate.alias("rate")).collect()
    assert min(r["rate"] for r in got) >= 1
    totals = [sum(r["tokens"] * r["rate"] * r["posterior"][j] for r in got) for j in range(2)]
    assert now == pytest.approx(totals, rel=1e-6)
    if met:
        assert totals == pytest.approx(goal, rel=1e-3)
        assert totals[0] / sum(totals) == pytest.approx(targets[0], rel=1e-3)


def test_rates_against_least_squares(spark):
    """With no bound in the way, rates are level + posterior x pull, pull by numpy from the normal equations."""
    rng = np.random.default_rng(4)
    tokens, p = rng.integers(1, 200, 500), rng.dirichlet([2, 1, 1], 500)
    members = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens long, posterior array<double>")
    targets = [0.4, 0.3, 0.3]
    rate, now, goal = mixing.fit_rates(members, targets, total=3.0 * tokens.sum())
    got = np.array([r["r"] for r in members.select(rate.alias("r")).collect()])
    moments = (tokens[:, None] * p).T @ p
    pull, *_ = np.linalg.lstsq(moments, np.array(goal) - 3.0 * (tokens @ p), rcond=None)
    assert got == pytest.approx(3.0 + p @ pull, abs=1e-3)
    assert (got * tokens) @ p == pytest.approx(goal, rel=1e-5)
    assert now == pytest.approx(goal, rel=1e-5)


def test_targets_out_of_reach_are_told(spark):
    members = spark.createDataFrame([(100, [0.6, 0.4])] * 5, "tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="differ from their targets"):
        mixing.fit_rates(members, [0.05, 0.95])


def test_contradicting_labels(spark, mixture):
    docs, labels = mixture
    twice = labels.unionByName(labels.withColumn("quality", F.lit(0)))
    one = sorted(map(str, mixing.rates(docs, twice, {"en": 0.5, "low": 0.5}).collect()))
    assert one == sorted(map(str, mixing.rates(docs, twice.repartition(5), {"en": 0.5, "low": 0.5}).collect()))
