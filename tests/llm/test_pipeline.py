"""The pipeline's stages over a small corpus, and the registered queries."""

import random

import corpus_pipeline
from corvane.llm import common, queries


def test_stages(spark, tmp_path):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    line = "This licence line is repeated in very many documents of the corpus."
    item = " ".join(word() for _ in range(20))
    docs = [(i, " ".join(word() for _ in range(40)) + ("\n" + line if i < 8 else ""), "en", f"s{i % 3}", 1) for i in range(120)]
    docs += [(200, docs[50][1], "en", "s", 1), (201, docs[51][1] + " more", "en", "s", 1), (202, "see " + item + " here", "en", "s", 1), (203, None, None, None, None)]
    docs += [(300 + i, " ".join(word() for _ in range(20)) + " slime grub " + word(), "en", "s", 1) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(300 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        df = common.stored(stage(spark, df, str(tmp_path)))
        kept[name] = {r["doc_id"]: r for r in df.collect()}
        if name != "mixing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i, *_ in docs if i < 300}
    assert set(kept["toxicity"]) == clean
    lines = [i for i, r in kept["line_dedup"].items() if line in (r["text"] or "")]
    assert lines == [7]
    assert kept["line_dedup"][0]["n_chars"] == len(kept["line_dedup"][0]["text"])
    assert set(kept["minhash_near_dedup"]) == clean - {200, 201}
    assert set(kept["benchmark_decontamination"]) == clean - {200, 201, 202}
    assert set(kept["mixing"]) == clean - {200, 201, 202}
    assert {"rate", "copies", "domain", "tokens"} <= set(df.columns)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept["mixing"])


def test_columns_of_the_user_stay(spark, tmp_path):
    random.seed(10)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    line = "This licence line is repeated in very many documents of the corpus."
    names = "score rejected n_lines n_dropped kept_sha256 posterior mark domain tokens rate copies node root bands hi lo ids n_hit items words print id".split()
    docs = [(i, (" ".join(word() for _ in range(30)) + "\n" + line) if i else None, "en", "s", 7, *[f"{n}{i}" for n in names]) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i > 50)) for i in range(1, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this occurs")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, given = spark.read.parquet(f"{tmp_path}/documents.parquet"), {d[0]: d for d in docs}
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, df, str(tmp_path)))
        assert out.columns[: len(df.columns)] == df.columns
        assert out.schema[: len(df.columns)] == df.schema[:]
        rows = out.collect()
        assert {r["doc_id"] for r in rows} >= {0}
        for r in rows:
            assert [r[n] for n in names] == list(given[r["doc_id"]][5:])
            assert (r["text"] is None) == (r["doc_id"] == 0)
            assert r["n_chars"] == (7 if name == "toxicity" or r["doc_id"] in (0, max(x["doc_id"] for x in rows)) else len(r["text"]))
        df = out if name != "mixing" else df
    assert out.columns[len(df.columns) :] == ["mixing_domain", "mixing_tokens", "mixing_rate", "mixing_copies"]


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
