"""Blocks of postings are put together from words as they come, without a shuffle of words."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.sources import blocks, segments


def test_portions_lose_and_repeat_nothing(monkeypatch):
    rng = random.Random(1)
    docs = {i: rng.choices("abcde", k=rng.choice([1, 3, 70])) for i in sorted(rng.sample(range(200), 60))}
    rows = [{"span": i // 8, "id": i, "dl": len(w), "place": n, "term": t} for i, w in docs.items() for n, t in enumerate(w)]
    schema = pa.schema([("span", pa.int64()), ("id", pa.int64()), ("dl", pa.int32()), ("place", pa.int32()), ("term", pa.string())])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=7)
    monkeypatch.setattr(blocks, "PORTION", 50)
    parts = list(blocks._portions(iter(batches)))
    found = [b for p in parts for b in blocks._grouped(p, True).to_pylist()]
    got = {(b["term"], i): (tf, dl, at) for b in found for i, tf, dl, at in zip(b["ids"], b["tfs"], b["dls"], b["at"], strict=True)}
    assert got == {(t, i): (w.count(t), len(w), [n for n, x in enumerate(w) if x == t]) for i, w in docs.items() for t in set(w)}
    assert len(parts) > 5 and sum(b["size"] for b in found) == len(got)  # nothing is there twice
    assert all(b["max_tf"] == max(b["tfs"]) and b["min_dl"] == min(b["dls"]) and {i // 8 for i in b["ids"]} == {b["span"]} for b in found)


def test_texts_are_shuffled_once_and_words_never(spark):
    texts = spark.range(50).select("id", F.concat(F.lit("the same "), F.col("id").cast("string")).alias("content"))
    plan = blocks.blocks(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1
    assert plan.index("MapInArrow") < plan.index("Generate") < plan.index("Exchange")  # from the last step to the first


def test_only_rows_that_repeat_an_id_are_compared(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(rows, "id long, content string")
    df((1, "a"), (2, "b")).write.parquet(str(tmp_path / "one"))
    plan = segments.once(spark, str(tmp_path / "one"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    df((1, "a"), (2, "b"), (2, "c"), (2, "c"), (3, None)).write.parquet(str(tmp_path / "two"))
    assert sorted(map(tuple, segments.once(spark, str(tmp_path / "two")).collect())) == [(1, "a"), (2, "c"), (3, None)]


def test_texts_by_id_are_not_shuffled_and_give_the_same_blocks(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([None, "", " .. ", "a A äK b-a\n9", "x" * 50, *[f"w{n % 7} the {n}" * 9 for n in range(60)]])] + [(None, "no id")]
    texts = spark.createDataFrame(rows, "id long, content string").coalesce(1).sortWithinPartitions("id")
    monkeypatch.setattr(blocks, "BYTES", 64)
    found = blocks.blocks(texts, positional=True, by_id=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    plain = lambda df: sorted(map(repr, df.select("term", "span", "max_tf", "min_dl", "size", "ids", "tfs", "dls", "at").collect()))
    assert plain(found) == plain(blocks.blocks(texts, positional=True)) != []


def test_stored_blocks_are_packed(spark, tmp_path):
    rows = [(10_000_000_000 + i * 3, "same same " + "t" * (i % 5)) for i in range(700)]
    blocks.store(spark.createDataFrame(rows, "id long, content string").repartition(1).sortWithinPartitions("id"), str(tmp_path / "b"), by_id=True)
    held = spark.read.parquet(str(tmp_path / "b"))
    assert held.schema["far"].dataType.elementType.simpleString() == "smallint"  # 2 bytes an id instead of 8
    got = {tuple(r) for r in blocks.postings(held).collect()}
    assert got == {(t, i, w.split().count(t), len(w.split())) for i, w in rows for t in set(w.split())}
    assert held.agg(F.sum("tokens")).first()[0] == sum(len(w.split()) for _, w in rows)
    bounds = blocks.BlockMax([(held, None)], held.groupBy("term").agg(F.sum("size").alias("df")), spark.createDataFrame([(700, 3.0)], "n long, avgdl double")).bounds(["same"])
    assert "tfs" not in bounds._jdf.queryExecution().executedPlan().toString()  # bounds come without postings


def test_vectors_join_in_the_shuffle_that_orders_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "id long, content string")
    vecs = spark.createDataFrame([(1, [1.0]), (3, None), (2, [2.0]), (2, [3.0]), (7, [7.0]), (None, [0.0])], "id long, vec array<double>")
    both = segments.by_id(rows, vecs)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(repr, both.collect())) == sorted(map(repr, rows.join(vecs, "id", "left").collect()))
