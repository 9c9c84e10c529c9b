"""Winnowing against brute force."""

import random
import re

import pytest

from corvane.llm import winnow

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        own = words(body)
        if item is None or not own:
            continue
        n = min(10, len(own))
        known = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in known:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def data():
    random.seed(8)
    word = lambda: random.choice(["ab", "cd", "É", "é", "İx", "ΑΣ", "x9", "Ef"]) + random.choice("abcdeé")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 12, 10, 9, 5, 3, 25])]
    items += [(20, items[0][1].upper()), (21, ""), (22, None), (None, items[1][1]), (9, items[6][1])]
    docs = []
    for i in range(150):
        body = [word() for _ in range(random.randint(0, 60))]
        if i % 2:
            src = (random.choice(items[:7])[1]).split()
            a = random.randint(0, max(0, len(src) - 9))
            body[random.randint(0, len(body)) :][:0] = []
            at = random.randint(0, len(body))
            body[at:at] = src[a : a + random.randint(8, 14)]
        docs.append((i, random.choice([" ", ", ", "--"]).join(body)))
    return docs + [(200, None), (201, ""), (None, items[0][1]), (202, items[0][1]), (202, items[0][1]), (203, (items[0][1] + " zz ") * 500)], items


def test_against_brute_force(spark, data):
    docs, items = data
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, mark int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in winnow.contamination(df, bench).collect())
    assert got == sorted((str(i), *brute(t, items)) for i, t in docs)


def test_decontaminate(spark, data):
    docs, items = data
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, mark int")
    kept = winnow.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in docs if not brute(t, items)[1])


def test_empty(spark, data):
    docs, items = data
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert winnow.contamination(df.limit(0), bench).collect() == []
    assert {r["n_hit"] for r in winnow.contamination(df, bench.limit(0)).collect()} == {0}


def test_guarantee(spark):
    """Texts that share GUARANTEE words in a row, wherever they stand, share a kept hash."""
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(200):
        shared = [word() for _ in range(winnow.GUARANTEE)]
        for side in "ab":
            rows.append((i, side, [word() for _ in range(random.randint(0, 30))] + shared + [word() for _ in range(random.randint(0, 30))]))
    prints = winnow.fingerprints(spark.createDataFrame(rows, "i int, side string, words array<string>"), [])
    by = {(r["i"], r["side"]): set(r["prints"]) for r in prints.collect()}
    assert all(by[i, "a"] & by[i, "b"] for i in range(200))
    assert sum(bool(by[i, "a"] & by[i + 1, "b"]) for i in range(199)) == 0
    kept = sum(len(by[i, "a"]) for i in range(200)) / sum(len(w) - winnow.K + 1 for _, s, w in rows if s == "a")
    assert kept < 0.6  # it is a selection


@pytest.mark.parametrize("chunk", [7, 16, 100])
def test_pieces_of_long_texts(spark, data, monkeypatch, chunk):
    docs, items = data
    monkeypatch.setattr(winnow, "CHUNK", chunk)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in winnow.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted((str(i), *brute(t, items)) for i, t in docs)
