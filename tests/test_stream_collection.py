"""Streams into a collection: batches that come again count once, other writers are followed."""

import shutil

import pytest
from pyspark.sql import functions as F

from corvane.functions.embed import HashEmbedder
from corvane.sources import manifest
from corvane.sources.collection import Collection
from corvane.streaming import ingest

SCHEMA = "n long, content string, role string, gone boolean"


def state(c):
    return (
        sorted((r["id"], r["content"], r["role"]) for r in c.points.collect()),
        sorted(map(tuple, c.postings.select("term", "id", "tf", "dl").collect())), sorted(map(tuple, c.term_stats.select("term", "df").collect())),
        [tuple(r) for r in c.corpus_stats.select("n", "avgdl").collect()], c.version,
    )


class Stream:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.path, self.n = spark, folder, str(folder / "c"), 0
        (folder / "in").mkdir()

    def add(self, rows):
        self.n += 1
        made = self.spark.createDataFrame(rows, SCHEMA).coalesce(1)
        made.write.json(str(self.folder / f"made{self.n}"))
        (part,) = (self.folder / f"made{self.n}").glob("part-*")
        shutil.copy(part, self.folder / "in" / f"{self.n}.json")

    def run(self, checkpoint="checkpoint", name="stream"):
        rows = self.spark.readStream.schema(SCHEMA).json(str(self.folder / "in"))
        q = ingest.stream_collection(rows, "c", self.path, HashEmbedder(8), str(self.folder / checkpoint), key="n", deleted="gone", stream=name, layout=("role",))
        q.awaitTermination()
        return Collection.read(self.spark, "c", self.path)


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, tmp_path)


FIRST = [(i, f"red sky {i}", "x", None) for i in range(20)] + [(None, "no id", "x", False), (3, "red again", "y", False)]
SECOND = [(3, None, None, True), (4, "blue", "x", False), (50, "new sky", "y", False), (5, "both", "x", True), (5, "both stays", "x", False), (99, None, None, True)]


def test_batches_equal_a_rebuild(spark, stream):
    stream.add(FIRST)
    stream.run()
    stream.add(SECOND)
    c = stream.run()
    now = {i: (i, t, r) for i, t, r, _ in FIRST if i is not None and i != 3} | {4: (4, "blue", "x"), 50: (50, "new sky", "y"), 5: (5, "both stays", "x")}
    want = Collection.create("c", str(stream.folder / "again"), spark.createDataFrame(list(now.values()), "n long, content string, role string"), HashEmbedder(8), key="n")
    assert state(c)[:4] == state(want)[:4]
    assert c.about["batches"] == {"stream": 1}
    assert c.compact().about["batches"] == {"stream": 1}


def test_a_batch_that_comes_again_counts_once(stream):
    """The rows hold, but the stream's own log of the batch is lost: it is asked for again."""
    stream.add(FIRST)
    before = state(stream.run())
    (commit,) = (f for f in (stream.folder / "checkpoint" / "commits").iterdir() if f.name == "0")
    commit.unlink()
    for crc in (stream.folder / "checkpoint" / "commits").glob(".0.crc"):
        crc.unlink()
    assert state(stream.run()) == before
    stream.add(SECOND)
    assert stream.run().about["batches"] == {"stream": 1}


def test_a_failure_before_the_manifest_changes_nothing(stream, monkeypatch):
    stream.add(FIRST)
    first = state(stream.run())
    stream.add(SECOND)
    real = manifest.commit
    monkeypatch.setattr(manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        stream.run()
    monkeypatch.setattr(manifest, "commit", real)
    assert state(Collection.read(stream.spark, "c", stream.path)) == first
    c = stream.run()
    assert c.about["batches"] == {"stream": 1}
    assert c.points.filter(F.col("id") == 50).count() == 1 and c.points.filter(F.col("id") == 3).isEmpty()


def test_other_writers_are_followed(spark, stream, monkeypatch):
    stream.add(FIRST)
    c = stream.run()
    stream.add(SECOND)
    real, others = manifest.commit, []

    def late(s, path, content, after):
        if not others:  # another writer is first
            others.append(real(s, path, c.about, after))
        return real(s, path, content, after)

    monkeypatch.setattr(manifest, "commit", late)
    got = stream.run()
    assert got.version == others[0] + 1 and got.about["batches"] == {"stream": 1}
    monkeypatch.setattr(manifest, "commit", real)
    # a second stream keeps its own number
    assert stream.run("other", "second").about["batches"] == {"stream": 1, "second": 0}
