"""Importance resampling against plain counts, and the parts of the hash and of the run lengths."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import importance


def runs(text, most=3):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, share=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in runs(x)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, x in docs:
        n, found = runs(x)
        weight = sum(gain(bucket(f)) for f in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, n])
    may = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for place, r in enumerate(may[: len(may) * share // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.fixture(scope="module")
def docs():
    random.seed(8)
    text = lambda n: " ".join(random.choice(["red", "Green", "blÜe", "x-y", "12", "q" * 70]) for _ in range(n))
    rows = [(i, text(random.choice([0, 1, 2, 19, 20, 21, 60]))) for i in range(150)]
    return [*rows, (None, text(40)), (7, text(30)), (7, text(30)), (500, None), (501, ""), (502, "?!"), (503, text(4000))]


def test_against_plain_counts(spark, docs):
    target = ["red 12 red", None, "blÜe x y", ""]
    df = spark.createDataFrame([(i, x, 1, "a") for i, x in docs], "doc_id long, text string, score int, stream string").repartition(5)
    found = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), share=20)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, target, share=20)


def test_empty_tables(spark, docs):
    some = spark.createDataFrame(docs[:30], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert importance.resample(some.limit(0), none).collect() == []
    assert sorted(map(tuple, importance.resample(some, none).collect()), key=repr) == brute(docs[:30], [])


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i % 5, i // 5, 3 if i < 40 else 2) for i in range(50)], "a int, doc_id long, score long").repartition(7)
    from pyspark.sql import functions as F

    got = importance.ranked(rows, F.desc("score"), "doc_id", "a").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 51))
    assert [(-r["score"], r["doc_id"], r["a"]) for r in got] == sorted((-r["score"], r["doc_id"], r["a"]) for r in got)


def test_crc_of_concatenations():
    first, then = [b"", b"a", b"x" * 300], [b" bc", b" " + b"y" * 1000, b" "]
    crc = lambda x: np.array(list(map(zlib.crc32, x)), np.uint32)
    got = importance.joined(crc(first), crc(then), np.array(list(map(len, then))))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(first, then, strict=True)]


def test_long_texts_are_split_in_pieces():
    text = b"ab  c " * 1000 + b"d" * 500 + b" e"
    assert [w for part in importance._pieces(text, 100) for w in part] == text.split()


def test_run_lengths():
    for x in (np.zeros(0, np.uint16), np.array([3, 1, 3, 3, 65535, 0], np.uint16)):
        held, times = importance.run_lengths(np.sort(x))
        assert dict(zip(held.tolist(), times.tolist(), strict=True)) == Counter(x.tolist())
