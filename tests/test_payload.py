"""Filters through bitmaps against filters of all points, after upserts and compaction too."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.embed import HashEmbedder
from corvane.operators import filters as fl
from corvane.sources import payload
from corvane.sources.collection import Collection

SCHEMA = "n long, content string, role string, tags array<string>, size int, weight double, ok boolean"
FIELDS = ("role", "tags", "size", "weight", "ok")
FILTERS = [
    {"role": "x"}, {"role": ["x", "y"], "size": {"gte": 3, "lt": 7}}, {"tags": "red"}, {"tags": ["red", "blue"], "role": "y"}, {"size": 5}, {"size": [1, 2, 9]},
    {"weight": {"gt": 0.25, "lte": 0.5}, "ok": True}, {"weight": 0.0}, {"role": "nobody"}, {"role": "x", "size": {"gt": 100}}, {"n": {"lt": 50}, "role": "x"},
    {"role": {"gte": "x", "lt": "y"}}, {"size": {"other": 1}, "role": "x"}, {"size": "5"}, {"size": []}, {"unknown": 1, "role": "x"}, {},
]


def rows(ids, seed):
    rng = random.Random(seed)
    colours = ["red", "green", "blue"]
    return [
        (i, f"text {i}", rng.choice(["x", "x", "y", None]), rng.choice([None, [], rng.sample(colours, 2), ["red", None]]), rng.choice([None, *range(10)]), rng.choice([None, 0.0, -0.0, 0.25, 0.5, float("nan")]), rng.choice([True, False, None]))
        for i in ids
    ]


@pytest.fixture(scope="module")
def versions(spark, tmp_path_factory):
    path, e = str(tmp_path_factory.mktemp("payload") / "c"), HashEmbedder(8)
    of = lambda ids, seed: spark.createDataFrame(rows(ids, seed), SCHEMA)
    # ids below zero and across ranges, a range in which one value has more ids than are listed
    ids = [-70000, -1, 0, *range(1, 3500), *range(payload.SPAN - 5, payload.SPAN + 5), 10**12]
    first = Collection.create("c", path, of(ids, 1), e, key="n", layout=("role",), indexed=FIELDS)
    second = first.upsert(of([*range(100, 200), 5_000_000], 2), e, removed=[-1, 0, 7])
    return {"first": first, "upsert": second, "compact": Collection.read(spark, "c", path).compact()}


def ids_of(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("version", ["upsert", "compact"])
def test_same_as_all_points(versions, version):
    c = versions[version]
    for f in FILTERS if version == "upsert" else FILTERS[1:7:2]:
        assert ids_of(c.filtered(f)) == ids_of(fl.where(c.points, f)), f
    assert ids_of(c.filtered({"class": "x"}, {"class": "role"})) == ids_of(fl.where(c.points, {"role": "x"}))
    assert ids_of(c.filtered(F.col("size") == 3)) == ids_of(c.points.filter("size = 3"))


def test_forms_and_whole_bitmaps(spark, versions):
    c = versions["compact"]
    held = spark.read.parquet(f"{c.path}/{c.about['segments'][0]['folder']}/payload")
    assert held.filter("bits IS NULL AND size(offsets) > 2048 OR bits IS NOT NULL AND bitmap_count(bits) <= 2048").isEmpty()
    got = payload.ids(payload.matching(held, [F.col("field") == "ok"]))
    assert ids_of(got) == ids_of(c.points.filter("ok IS NOT NULL"))


def test_files_without_hits_are_not_read(spark, tmp_path):
    df = spark.range(40_000).select(F.col("id").alias("n"), F.lit("t").alias("content"), F.concat(F.lit("r"), F.floor(F.col("id") / 10_000)).alias("role"), (F.col("id") % 7).alias("size"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of few rows
    try:
        c = Collection.create("c", str(tmp_path / "c"), df.repartition(4), HashEmbedder(4), key="n", layout=("role",), indexed=("role", "size"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = spark.read.parquet(f"{c.path}/{c.about['segments'][0]['folder']}/payload")
    assert not held.filter("bits IS NOT NULL").isEmpty() and not held.filter("bits IS NULL").isEmpty()
    found = c.filtered({"role": "r1", "size": 3})
    assert ids_of(found) == [i for i in range(10_000, 20_000) if i % 7 == 3]
    points = lambda df: {f for f in df.inputFiles() if "/points/" in f}
    assert 0 < len(points(found)) < len(points(c.points))
    assert c.filtered({"role": "r1", "size": 9}).count() == 0


def test_types_that_have_no_index(spark, tmp_path):
    df = spark.sql("SELECT 1L AS n, 'a' AS content, current_date() AS day")
    with pytest.raises(ValueError, match="day"):
        Collection.create("c", str(tmp_path / "c"), df, HashEmbedder(4), key="n", indexed=("day",))
