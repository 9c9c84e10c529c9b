"""Filters, collections, ranked search, build steps and the command line."""

import json

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane import cli
from corvane.config import Config, load_config, read_env_file
from corvane.functions import scoring
from corvane.functions.embed import HashEmbedder, ModelEmbedder
from corvane.operators import filters as fl
from corvane.operators import retriever as rt
from corvane.plans import build
from corvane.plans.queries import CLASSES, SNIPPETS
from corvane.sources.collection import Collection, with_positions

TEXTS = ["red apple on a tree", "green apple pie", "a blue sky", "the red sky at night red", "", "tree of life"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, ["x", "y"][i % 2], ["a"] if i < 3 else ["a", "b"], float(i), ["How red?"] if i == 0 else []) for i, t in enumerate(TEXTS)], "n long, content string, role string, tags array<string>, score_ double, queries array<string>")


@pytest.fixture(scope="module")
def engine(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("c"))
    Collection.create("code", path, rows.withColumn("chunk_id", F.col("n").cast("string")), HashEmbedder(32), key="n")
    return rt.Retriever({"code": Collection.read(spark, "code", path)}, HashEmbedder(32))


def ids(df):
    return [r[0] for r in df.orderBy(df.columns[0]).select(df.columns[0]).collect()]


def test_filters(rows):
    assert fl.build_filter(rows, None) is None
    assert fl.build_filter(rows, {}) is None
    given = F.col("n") > 1
    assert fl.build_filter(rows, given) is given
    assert isinstance(fl.build_filter(rows, {"role": "x"}), Column)
    assert ids(fl.where(rows, {"role": "x"})) == [0, 2, 4]
    assert ids(fl.where(rows, {"tags": "b"})) == [3, 4, 5]
    assert ids(fl.where(rows, {"tags": ["b", "c"]})) == [3, 4, 5]
    assert ids(fl.where(rows, {"n": [1, 5, 9]})) == [1, 5]
    assert ids(fl.where(rows, {"score_": {"gte": 1.0, "lt": 3.0, "lte": None}})) == [1, 2]
    assert ids(fl.where(rows, {"role": "x", "n": {"gt": 0}, "tags": "a"})) == [2, 4]
    assert ids(fl.where(rows, {"nowhere": 1})) == []


def test_filter_builder(spark, rows):
    b = fl.FilterBuilder(rows).exclude("role", "x").should_match("tags", "b").match_text("content", "APPLE")
    assert rows.filter(b.build()).select("n", b.boost().alias("b")).collect() == [(1, 0)]
    nulls = spark.createDataFrame([(1, None), (2, "x")], "n int, role string")
    assert ids(nulls.filter(fl.FilterBuilder(nulls).exclude("role", "x").build())) == [1]
    assert fl.FilterBuilder(rows).build() is None


def test_hash_embedder_agrees_with_its_column(spark, rows):
    e = HashEmbedder(32)
    for r in rows.select("content", e.column(F.col("content")).alias("v")).collect():
        assert r["v"] == e.one(r["content"])


def test_positions_are_contiguous(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = sorted((r["x"], r["position"]) for r in with_positions(df, "x").collect())
    assert [p for _, p in got] == list(range(1000))


def test_modes(engine):
    sparse = engine.bm25_search("red sky", "code").select("id", "score").collect()
    assert [r["id"] for r in sparse][0] == 3
    assert {r["id"] for r in sparse} == {0, 2, 3}
    dense = engine.search("red sky", "code", limit=3).select("id").collect()
    assert dense[0]["id"] in (2, 3)
    hybrid = engine.hybrid_search("red sky", "code", limit=10).select("id", "score").collect()
    assert hybrid[0]["id"] == 3
    assert len(hybrid) == 5  # the empty text has no length
    only = engine.hybrid_search("red sky", "code", filters={"role": "x"}).select("id").collect()
    assert {r["id"] for r in only} <= {0, 2, 4}
    asked = engine.search("how red", "code", limit=1, vector_name="queries").select("id").collect()
    assert asked[0]["id"] == 0
    assert engine.search_by_role("sky", "y").count() <= 3


def test_statistics_ignore_filters(engine):
    every = {r["id"]: r["score"] for r in engine.bm25_search("red", "code").collect()}
    some = {r["id"]: r["score"] for r in engine.bm25_search("red", "code", filters={"role": "y"}).collect()}
    assert some == {k: v for k, v in every.items() if k in some}


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    b = spark.createDataFrame([(2, 7.0), (3, 1.0)], "id long, score double")
    assert rt.fuse([a, b], 5).collect() == rt.fuse([b, a], 5).collect()
    assert rt.fuse([a, b], 1).first()["id"] == 2
    assert scoring.rrf([scoring.ranked(a, "score", "id")], "id").count() == 2


def test_maxsim_is_no_less_than_any_vector(engine):
    c = engine.collections["code"]
    q = HashEmbedder(32).one("red apple")
    best = {r["id"]: r["score"] for r in rt.multi_vector(c.query_vectors, q, 10).collect()}
    for r in rt.dense(c.query_vectors, q, 10).collect():
        assert best[r["id"]] >= r["score"]


def test_results_fall_back(spark):
    df = spark.createDataFrame([(1, 0.5, None, "vtkA", ("m",))], "id long, score double, content string, vtk_class string, metadata struct<module:string>")
    r = rt.project_result(df, "docs").first()
    assert (r["class_name"], r["module"], r["content"], r["visibility_score"], r["collection"]) == ("vtkA", "m", "", 0.0, "docs")


def test_merge_and_samples(spark, rows):
    a = spark.createDataFrame([(1, 0.5), (2, 0.9)], "id long, score double")
    b = spark.createDataFrame([(0, 0.5)], "id long, score double")
    assert [(r["collection_order"], r["id"]) for r in rt.merge_collections([a, b], 3).collect()] == [(0, 2), (0, 1), (1, 0)]
    assert {(r["role"], r["n"]) for r in rt.sample_per_group(rows, "role", 1, "n").collect()} == {("x", 0), ("y", 1)}


def test_wished_conditions_rank(engine):
    points = engine.collections["code"].points
    plain = [r["id"] for r in engine.bm25_search("red apple tree", limit=6).collect()]
    wished = fl.FilterBuilder(points).exclude("n", 1).should_match("role", "y")
    got = engine.bm25_search("red apple tree", limit=6, filters=wished).collect()
    assert "boost" not in got[0].asDict()
    assert [r["id"] for r in got] == sorted((i for i in plain if i != 1), key=lambda i: (i % 2 == 0, plain.index(i)))


def test_ids_are_the_same_in_all_tables(spark, tmp_path):
    """Rows that tie in the order of a collection: every table knows a text by one id."""
    same = spark.createDataFrame([("unknown", 1, f"text number{i}") for i in range(50)] * 2, "example_id string, chunk_no int, content string").repartition(7)
    c = Collection.create("code", str(tmp_path / "c"), same, HashEmbedder(16), order=("example_id", "chunk_no"))
    texts = {r["id"]: r["content"] for r in c.points.collect()}
    assert sorted(texts) == list(range(100))
    for r in c.postings.filter("term LIKE 'number%'").collect():
        assert texts[r["id"]].endswith(r["term"])
    assert not list((tmp_path / "c").glob("*/.staged"))
    assert c.info().first()["points_count"] == 100
    assert {r["df"] for r in c.term_stats.filter("term <> 'text'").collect()} == {2}
    again = Collection.create("code", str(tmp_path / "c"), same.limit(3), HashEmbedder(16), order=("example_id", "chunk_no"))
    assert again.points.count() == 3


def test_index_is_pruned_by_term(spark, engine):
    plan = engine.bm25_search("red", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,red)" in plan or "In(term, [red" in plan


def test_model_embedder(spark, tmp_path):
    times = []

    def load():
        times.append(1)
        return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]

    e = ModelEmbedder(load, 2)
    assert [e.one("tree"), e.one("be")] == [[4.0, 2.0], [2.0, 1.0]]
    assert len(times) == 1
    df = spark.createDataFrame([(0, "tree"), (1, None), (2, "be")], "n long, content string")
    assert [r["v"] for r in df.orderBy("n").select(e.column(F.col("content")).alias("v")).collect()] == [[4.0, 2.0], [0.0, 0.0], [2.0, 1.0]]
    Collection.create("docs", str(tmp_path / "m"), df, e, key="n")
    found = rt.Retriever({"docs": Collection.read(spark, "docs", str(tmp_path / "m"))}, e, docs="docs").search_docs("tree", hybrid=False).collect()
    assert [r["id"] for r in found] == [0, 2]


def test_products_of_odd_vectors(spark):
    rows = [(0, [3.0, 4.0]), (1, None), (2, [1.0]), (3, []), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r["id"]: (r["c"], r["n"]) for r in df.select("id", scoring.cosine(F.col("v"), [1.0, 0.0]).alias("c"), scoring.norm(F.col("v")).alias("n")).collect()}
    assert got[0] == (pytest.approx(0.6), 5.0)
    assert got[6] == (1.0, 1.0)
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == [None] * 5
    assert got[1][1] is None


def test_config():
    c = load_config({"CORVANE_TOP_K": "7", "CORVANE_USE_HYBRID": "no", "CORVANE_MIN_VISIBILITY_SCORE": "0.5"})
    assert (c.top_k, c.use_hybrid, c.min_visibility_score, c.prefetch) == (7, False, 0.5, 20)


def test_env_file(tmp_path):
    (tmp_path / "e").write_text("# no\nexport CORVANE_TOP_K='9'\nnothing\n")
    assert read_env_file(tmp_path / "e") == {"CORVANE_TOP_K": "9"}
    assert read_env_file(tmp_path / "missing") == {}


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([]) == 1
    with pytest.raises(SystemExit):
        cli.main(["search", "x", "--hybrid", "--bm25"])
    raw = tmp_path / "raw"
    raw.mkdir()
    config = Config(raw_dir=str(raw), processed_dir=str(tmp_path / "p"), index_dir=str(tmp_path / "i"), dimension=16)
    assert cli.main(["build"], spark, config) == 1
    (raw / "examples.jsonl").write_text("\n".join(json.dumps({"id": i, "code": c}) for i, c in SNIPPETS) + "\n\n" + json.dumps({"id": "empty"}) + "\n")
    (raw / "tests.jsonl").write_text(json.dumps({"code": "s = vtkSphereSource()"}) + "\n")
    (raw / "docs.jsonl").write_text("\n".join(json.dumps({"class_name": c[0], "module_name": c[1], "role": c[2], "visibility_score": c[3], "action_phrase": c[4], "class_doc": "About " + c[0]}) for c in CLASSES))
    assert cli.main(["build"], spark, config) == 0
    out = capsys.readouterr().out
    assert "'docs': 14" in out
    assert "'files': 5, 'files_without_code': 1, 'chunks': 6, 'files_with_chunks': 3" in out
    # the points of a collection lie in the order of its filters
    assert [r["chunk_type"] for r in Collection.read(spark, "docs", str(tmp_path / "i" / "docs")).points.collect()] == ["class_overview"] * 7 + ["constructor"] * 7
    assert build.main(["--index"], spark, config) == 0
    assert "'docs': 14" in capsys.readouterr().out
    found = build.retriever(spark, config)
    assert found.search_by_class("vtkActor").first()["class_name"] == "vtkActor"
    assert found.search_by_class("vtkActor", "code").count() == 1
    assert cli.main(["search", "vtkActor", "--bm25", "-n", "2", "-v"], spark, config) == 0
    out = capsys.readouterr().out.strip().splitlines()
    assert len(out) == 2
    assert cli.main(["search", "sphere", "--docs", "--type", "constructor", "--class-name", "vtkSphereSource"], spark, config) == 0
    assert "vtkSphereSource_constructor" in capsys.readouterr().out
    assert cli.main(["roles", "docs", "-n", "1", "--output", str(tmp_path / "r.txt")], spark, config) == 0
    assert "? What is vtkActor?" in (tmp_path / "r.txt").read_text()
    assert "properties: 1" in (tmp_path / "r.txt").read_text()
    assert cli.main(["search", "sphere", "--code", "--pythonic", "true"], spark, config) == 0
    assert "Pipeline_chunk" in capsys.readouterr().out
    few = Config(**{**config.__dict__, "top_k": 1, "min_visibility_score": 0.85, "use_hybrid": False})
    engine = build.retriever(spark, few)
    assert cli.main(["search", "sphere renderer", "--bm25"], spark, few) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 1
    assert min(r["visibility_score"] for r in engine.search_docs("renderer", limit=9).collect()) >= 0.85
    assert engine.search_code("renderer").collect() == engine.search("renderer", "code").collect()
    renamed = Config(**{**config.__dict__, "code_collection": "snippets", "docs_collection": "api"})
    assert build.main([], spark, renamed) == 0
    assert build.retriever(spark, renamed).search_by_class("vtkActor").first()["collection"] == "api"
    assert cli.main(["search", "vtkSphereSource", "--docs", "--bm25", "-n", "1"], spark, renamed) == 0
    assert "api | vtkSphereSource" in capsys.readouterr().out
    assert cli.main(["roles", "code", "-n", "1"], spark, renamed) == 0
    assert build.main(["--clean"], spark, Config(**{**config.__dict__, "processed_dir": str(tmp_path / "no"), "index_dir": str(tmp_path / "no")})) == 0
    assert "nothing" in capsys.readouterr().out
    assert cli.main(["clean"], spark, config) == 0
    assert not (tmp_path / "p").exists()


def test_streaming_ingest(spark, tmp_path):
    from corvane.operators import api_dim
    from corvane.plans.queries import CLASS_SCHEMA
    from corvane.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"class_name": "vtkNew", "class_doc": "New.\nSuperclass: vtkActor"}) + "\n")
    classes = spark.createDataFrame(CLASSES, CLASS_SCHEMA)
    for _ in range(2):  # a second run finds nothing new
        ingest.stream_docs(spark, str(tmp_path / "in"), classes, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["chunk_id"] for r in rows) == ["vtkNew_constructor", "vtkNew_inheritance", "vtkNew_overview"]
    assert api_dim.module_classes(classes, "mod.Math").collect()[0]["class"] == "vtkMath"


def test_positions_are_those_of_one_numbering(spark):
    """Columns that the counts by partition don't need change what is sampled for ranges."""
    from corvane.sources.collection import with_positions

    rows = spark.range(30_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("a"), "id", F.concat_ws("", *[F.sha2((F.col("id") + i).cast("string"), 512) for i in range(4)]).alias("t"))
    got = with_positions(rows, "a", "id").collect()
    assert sorted(r["position"] for r in got) == list(range(30_000))
    assert [r["position"] for r in sorted(got, key=lambda r: (r["a"], r["id"]))] == list(range(30_000))
