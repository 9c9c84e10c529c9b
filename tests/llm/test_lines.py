"""Perfect hash and line dedup against brute force, on both ways."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm import lines


def brute(docs, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    ids = defaultdict(set)
    rank = lambda i: -(1 << 63) if i is None else i
    for i, t in docs:
        for k in (t or "").split("\n"):
            ids[key(k)].add(rank(i))
    held, last = {k: len(v) for k, v in ids.items()}, {k: max(v) for k, v in ids.items()}
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(k := key(x)) >= min_chars and held[k] >= min_docs and last[k] != rank(i))]
        out.append((rank(i), len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    random.seed(2)
    common = ["A repeated line that is long enough to be counted, number %d" % i for i in range(6)] + ["É" * 40, "ß" * 39 + "\t", "x" * 39]
    out = [(i, "\n".join(random.choice(common) if random.random() < 0.6 else f"own {i} {random.random()}" * 3 for _ in range(random.randint(0, 12)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, "\n\n"), (None, common[0]), (3, out[3][1]), (103, "  " + common[0].upper() + " \r"), (104, ("long " * 30 + "\n") * 4000)]
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_brute_force(spark, docs, limit):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_lines int").repartition(3)
    got = lines.dedup_lines(df, broadcast_bytes=limit)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"]
    rank = lambda i: -(1 << 63) if i is None else i
    assert sorted((rank(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()) == brute(docs)


def test_many_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_ENTRIES", 2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (1 << 20, 0):
        assert sum(r["n_dropped"] for r in lines.dedup_lines(df, broadcast_bytes=limit).collect()) == sum(x[2] for x in brute(docs))


def test_an_id_counts_once(spark):
    line = "One line that is long enough to be counted by the operator."
    df = spark.createDataFrame([(1, line)] * 5 + [(3, line), (None, line), (None, line)], "doc_id long, text string").repartition(3)
    for limit in (1 << 20, 0):
        assert {r["n_dropped"] for r in lines.dedup_lines(df, broadcast_bytes=limit).collect()} == {0}
    more = df.unionByName(spark.createDataFrame([(4, line), (5, line)], "doc_id long, text string"))
    for limit in (1 << 20, 0):
        got = lines.dedup_lines(more, broadcast_bytes=limit).collect()
        assert sorted((str(r["doc_id"]), r["text"]) for r in got if r["n_dropped"] == 0) == [("5", line)]


def test_null_texts_stay_null(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for limit in (1 << 20, 0):
        assert {(r["doc_id"], r["text"], r["n_lines"]) for r in lines.dedup_lines(df, broadcast_bytes=limit).collect()} == {(1, None, 1), (2, "", 1)}


def test_salts_follow_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr(lines, "PROBES", 20)
    line = "A hot line that a third of all documents hold, every one of them."
    df = spark.createDataFrame([(i, line if i % 3 == 0 else f"own line of document {i} which nobody else holds at all") for i in range(300)], "doc_id long, text string")
    salts = {r["shard"]: r["salts"] for r in lines.shard_salts(df, 4, 40).collect()}
    assert max(salts.values()) >= 5
    assert sum(r["n_dropped"] for r in lines.dedup_lines(df, broadcast_bytes=0).collect()) == 99


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(df).collect() == []


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    mph = lines.PerfectHash.build(keys)
    assert sorted(mph.index(keys).tolist()) == list(range(len(keys)))
    hi, lo = keys, keys[::-1].copy()
    shard = lines.LineShard.load(lines.LineShard.build(hi, lo, np.arange(len(keys)), np.arange(len(keys)) * 7).dump())
    known, last = shard.last_holder(hi, lo)
    assert known.all()
    assert (last == np.arange(len(keys)) * 7).all()
    assert not shard.last_holder(hi, lo + np.uint64(1))[0].any()
    assert not lines.LineShard.load(lines.LineShard.build(*[np.zeros(0, np.uint64)] * 2, np.zeros(0), np.zeros(0)).dump()).last_holder(hi, lo)[0].any()
