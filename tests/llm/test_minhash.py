"""Near duplicates against all pairs, and components of links."""

import random

import numpy as np
import pytest

from corvane.llm import graph, minhash


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1 :]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.fixture(scope="module")
def docs():
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    out, n = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two\n"), (5, "one two three")], 10
    for _ in range(6):
        base = [word() for _ in range(60)]
        for _ in range(25):  # copies with few to many edits, some of them shared
            text = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3, 4])):
                at = random.randrange(60)
                text[at] = random.choice([word(), "shared", text[at].upper()])
            out.append((n, " ".join(text)))
            n += 1
    passage = " ".join(word() for _ in range(40))
    out += [(n + k, passage + " " + " ".join(word() for _ in range(40))) for k in range(40)]
    random.shuffle(out)
    return out


def test_against_all_pairs(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, bands string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(df).collect()}
    assert got == brute(docs)


def test_dedup_keeps_columns_and_one_of_each(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, root string")
    kept = minhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute(docs).values()})


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in minhash.components(df).collect()) == [(0, 2, None), (7, 2, 7), (7, 2, 7), (9, 2, 7)]
    assert sorted(str(r["doc_id"]) for r in minhash.dedup(df).collect()) == ["7", "None"]
    assert minhash.components(df.limit(0)).collect() == []
    assert minhash.dedup(df.limit(0)).collect() == []


def test_one_id_with_several_texts(spark):
    a, other = "one two three four five six seven eight nine ten " * 3, "nothing here is like the rest of it at all or in part"
    near = a.replace("ten", "ten", 1) + "eleven"
    rows = [(7, a, "z"), (8, near, "y"), (7, other, "a"), (9, other, "x"), (7, None, "w"), (7, "", "v"), (11, "alone", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in minhash.components(df).collect())
    assert got == [(7, False, 7), (7, False, 7), (7, True, 7), (7, True, 7), (8, True, 7), (9, True, 7), (11, True, 11)]
    kept = sorted((r["doc_id"], r["text"] or "", r["node"]) for r in minhash.dedup(df).collect())
    assert kept == [(7, "", "v"), (7, "", "w"), (7, other, "a"), (11, "alone", "u")]  # `nothing ..` comes before `one ..` as JSON
    # the same classes with an unrelated text of the same id between them
    two = spark.createDataFrame([(7, a), (8, near)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.components(two).collect()} == {7}


def test_a_repeated_row_is_one_document(spark):
    df = spark.createDataFrame([(5, "a b c d e f g h")] * 400 + [(6, "a b c d e f g h i"), (4, "q w e r t y u i")], "doc_id long, text string").repartition(6)
    assert {(r["doc_id"], r["component_id"]) for r in minhash.components(df).collect()} == {(5, 5), (6, 5), (4, 4)}
    assert sorted(r["doc_id"] for r in minhash.dedup(df).collect()) == [4, 5]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    sig = minhash.signatures([a, b], bands=512, rows=1)
    assert abs((sig[0] == sig[1]).mean() - 1800 / 2200) < 0.06


def test_permutation_is_a_bijection():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash.permute(x, 1))) == len(np.unique(x))


def test_graph(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 130)]
    df = spark.createDataFrame([*chain, *star, (500, 500), (40, 39)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df, "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}
    assert graph.components(df.limit(0), "a", "b").collect() == []
