"""The n-gram join against all pairs; its filters lose no pair and its order is one order."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import minhash, ngram_join


def shingles(text, size=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, part=90):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1 :]:
            if s and u and 100 * len(s & u) >= part * len(s | u):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def run(spark, docs, parts=5):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, prefix string").repartition(parts)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(df).collect())


@pytest.fixture(scope="module")
def docs():
    """Copies of texts with edits in few places, groups without their original, shared passages, and short texts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out, n = [(0, None), (1, ""), (2, " \t\n\x0b"), (3, "one two"), (4, "ONE\ttwo\n"), (5, "one two three"), (6, "ONE two three"), (7, "one")], 10
    for length in (12, 40, 75, 160):
        base = [word() for _ in range(length)]
        for _ in range(14):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(length)
                text[at] = rng.choice([word(), "shared", text[at].upper()])
            if rng.random() < 0.3:
                text += [word() for _ in range(rng.randrange(4))]
            out.append((n, " ".join(text)))
            n += 1
    passage = " ".join(word() for _ in range(40))
    out += [(n + k, passage + " " + " ".join(word() for _ in range(rng.choice([0, 1, 2, 30])))) for k in range(25)]
    rng.shuffle(out)
    return out


def test_against_all_pairs(spark, docs):
    assert run(spark, docs) == brute(docs)


def test_members_that_no_star_joins(spark, monkeypatch):
    """Without rounds of stars all is left to the exact join between components; with an order by hash alone as well."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    chain = [(i, " ".join(base[i : i + 40])) for i in range(20)]  # each is like the next
    edits = [(100 + i, " ".join("x" if j == rng.randrange(60) else w for j, w in enumerate(base))) for i in range(12)]
    want = brute(chain + edits)
    assert run(spark, chain + edits) == want
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "rarity", lambda s: np.ones(ngram_join.SLOTS, np.int64))
    assert run(spark, chain + edits) == want


def test_odd_rows(spark):
    text = "a b c d e f"
    rows = [(None, text), (None, None), (7, text), (7, text), (9, text), (11, "g h i j"), (12, "g h i j"), (11, text), (13, None), (13, "g h i k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.components(df).collect() if r["doc_id"])
    assert got == [(7, 4, 7), (7, 4, 7), (9, 4, 7), (11, 2, 7), (11, 4, 7), (12, 2, 7), (13, 0, 13), (13, 5, 13)]
    assert sorted((r["n_shingles"], r["component_id"]) for r in ngram_join.components(df).collect() if r["doc_id"] is None) == [(0, None), (4, None)]
    assert ngram_join.components(df.limit(0)).collect() == []
    assert [tuple(r) for r in ngram_join.components(df.filter("doc_id = 9")).collect()] == [(9, 4, 9)]


def test_prefix_sizes_lose_no_pair():
    for n in range(1, 400):
        for m in range(n, 400):
            t = next(t for t in range(n + 1) if 100 * t >= 90 * (n + m - t)) if 100 * n >= 90 * m else None
            if t is not None:
                assert n - t + 1 <= ngram_join.prefix_size(n) and m - t + 1 <= ngram_join.prefix_size(m)


def test_filters_lose_no_pair(spark):
    """Random pairs near the threshold: whatever is similar passes each filter at its first common place, and the filters do take pairs out."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, ngram_join.SLOTS)
    order = ngram_join.Order(counts)
    rows, similar = [], []
    for _ in range(300):
        n = int(rng.integers(20, 120))
        whole = rng.integers(0, 1 << 63, n + 30, dtype=np.uint64) * np.uint64(2)
        k = int(rng.integers(0, n // 6))
        a, b = order.places(whole[:n]), order.places(np.r_[whole[k:n], whole[n : n + int(rng.integers(0, 10))]])
        common = np.intersect1d(a, b)
        i, j = (int(np.searchsorted(x, common[0])) + 1 for x in (a, b))
        ends = [np.searchsorted(x, order.pivots).tolist() for x in (a, b)]
        rows.append((len(a), i, ends[0], len(b), j, ends[1]))
        similar.append(100 * len(common) >= 90 * (len(a) + len(b) - len(common)))
    df = spark.createDataFrame([(x, *r) for x, r in enumerate(rows)], "x int, n long, i long, a array<int>, m long, j long, b array<int>")
    cols = [F.col(c) for c in "niamjb"]
    got = df.select("x", ngram_join.fits(cols[0], cols[1], cols[3], cols[4], F.lit(1)).alias("p"), ngram_join.suffixes_fit(*cols, F.lit(1)).alias("s")).orderBy("x").collect()
    for r, near in zip(got, similar, strict=True):
        assert not near or (r["p"] and r["s"])
    assert 0 < sum(similar) < sum(r["p"] for r in got) and sum(r["p"] and r["s"] for r in got) < sum(r["p"] for r in got)


def test_counters_are_packed_and_unpacked():
    for held, most in ((0.0001, 3), (0.3, 200), (0.9, 70_000), (0.001, 1 << 40), (1.0, 255)):
        rng = np.random.default_rng(1)
        counts = np.where(rng.random(ngram_join.CHUNK) < held, rng.integers(1, most + 1, ngram_join.CHUNK), 0)
        counts[5] = most
        assert (ngram_join._counters(ngram_join._packed(counts)) == counts).all()


def test_rarer_shingles_come_first(spark):
    common_text, n = "the same few words in all of these texts here", 40
    df = spark.createDataFrame([(i, f"{common_text} x{i} y{i} z{i}") for i in range(n)], "doc_id long, text string").repartition(4)
    sketched = ngram_join.sketch(df)
    counts = ngram_join.rarity(sketched)
    order = ngram_join.Order(counts)
    words = minhash.Words()
    (shared,), (own,) = (minhash.shingle_sets([t.encode()], words, 3) for t in (common_text, "x3 y3 z3"))
    assert (counts[ngram_join.slot(shared)] >= n).all()
    assert order.places(own).max() < order.places(shared).min()
    assert counts.sum() == sum(len(shingles(f"{common_text} x{i} y{i} z{i}")) for i in range(n))


def test_repeated_shingles_of_long_lists(spark):
    """Many sets that share one text and differ in one place: lists as long as the table, joined through one member."""
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join([*base[: i % 80], f"own{i}", *base[i % 80 + 1 :]]) if i else " ".join(base)) for i in range(300)]
    got = run(spark, docs, 3)
    assert {c for _, _, c in got} == {0}
