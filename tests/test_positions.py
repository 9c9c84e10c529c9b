"""Words and phrases by stored places against plain Python, after upserts and compaction, and without an index."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions.embed import HashEmbedder
from corvane.operators import filters as fl
from corvane.operators import retriever as rt
from corvane.sources.collection import Collection

WORDS = ["art", "part", "the", "the", "of", "night", "of"]
ASKED = ["the the", "of the night", "The  ART!", "art", "part of", "of of of", "nobody", "the nobody", "", "?!", "of the of the"]


def texts(ids, seed):
    rng = random.Random(seed)
    odd = {0: None, 1: "", 2: "The the THE-the", 3: "é art é", 4: "of " * 3000 + "night"}
    return [(i, odd.get(i % 40, ", ".join(rng.choices(WORDS, k=rng.randrange(9)))), rng.choice(["x", "y"])) for i in ids]


def words_of(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def starts(t, phrase):
    w, p = words_of(t), words_of(phrase)
    return [i for i in range(len(w) - len(p) + 1) if p and w[i : i + len(p)] == p]


@pytest.fixture(scope="module")
def versions(spark, tmp_path_factory):
    path, e = str(tmp_path_factory.mktemp("places") / "c"), HashEmbedder(8)
    df = lambda rows: spark.createDataFrame(rows, "n long, content string, role string")
    old, new = texts(range(120), 1), texts([5, 6, 7, 300, 301], 2)
    c = Collection.create("c", path, df(old), e, key="n", positional=True).upsert(df(new), e, removed=[8, 9, 42])
    now = {r[0]: r for r in old} | {r[0]: r for r in new}
    now = {i: r for i, r in now.items() if i not in (8, 9, 42)}
    return {"upsert": c, "compact": Collection.read(spark, "c", path).compact()}, now


@pytest.mark.parametrize("version", ["upsert", "compact"])
def test_phrases_and_words(versions, version):
    c, now = versions[0][version], versions[1]
    for asked in ASKED:
        want = {i: s for i, r in now.items() if (s := starts(r[1], asked))}
        assert {r["id"]: r["starts"] for r in c.phrase(asked).collect()} == want, asked
        p = set(words_of(asked))
        assert {r["id"] for r in c.words(asked).collect()} == {i for i, r in now.items() if p and p <= set(words_of(r[1]))}, asked


def test_conditions_without_an_index(versions):
    points, now = versions[0]["compact"].points, versions[1]
    for asked in ASKED:
        b = fl.FilterBuilder(points)
        assert {r["id"] for r in points.filter(b.match_phrase("content", asked).build()).collect()} == {i for i, r in now.items() if starts(r[1], asked)}, asked
        p = set(words_of(asked))
        got = points.filter(fl.FilterBuilder(points).match_text("content", asked).build())
        assert {r["id"] for r in got.collect()} == {i for i, r in now.items() if p and p <= set(words_of(r[1]))}, asked


def test_only_lists_of_the_words_are_asked_for(versions):
    plan = versions[0]["compact"].phrase("of the night")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [night,of,the])" in plan and "/points" not in plan


def test_phrase_search(spark, versions, tmp_path):
    c, now = versions[0]["upsert"], versions[1]
    plain = Collection.create("c", str(tmp_path / "plain"), spark.createDataFrame(list(now.values()), "n long, content string, role string"), HashEmbedder(8), key="n")
    for held in (c, plain):
        by = rt.Retriever({"c": held}, HashEmbedder(8), code="c")
        got = {r["id"]: r["score"] for r in by.phrase_search("of the", limit=1000, filters={"role": "x"}).collect()}
        every = {r["id"]: r["score"] for r in by.bm25_search("of the", limit=1000).collect()}
        assert got == {i: every[i] for i, r in now.items() if r[2] == "x" and starts(r[1], "of the")} and got
    with pytest.raises(ValueError):
        plain.phrase("of the")


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "n long, content string")
    c = Collection.create("c", str(tmp_path / "c"), none, HashEmbedder(4), key="n", positional=True)
    assert c.phrase("a b").collect() == [] and c.words("a").collect() == []
    assert c.points.filter(F.lit(True)).count() == 0
