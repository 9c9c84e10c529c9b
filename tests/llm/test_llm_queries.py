"""Registered queries with SQL give its rows; the others give a row each; neighbours are held against all distances."""

import os

import numpy as np
import pytest
from oracle import DATA, same

from corvane.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_lm_scores", "op3_toxicity", "op6_mixing", "op7_pii"])
def test_a_row_a_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()
    assert sorted(queries.QUERIES[name](spark, DATA).select("doc_id").collect()) == sorted(docs)


def test_neighbours_against_all_distances(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids, vectors = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    found: dict[int, list] = {}
    for r in queries.QUERIES["op10_ann"](spark, DATA).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r)
    assert sorted(found) == sorted(set(ids[ids % 100 == 0].tolist()))
    caught = whole = 0
    for q, mine in found.items():
        far = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        assert [r["rank"] for r in mine] == list(range(1, len(order) + 1))
        assert [r["score"] for r in mine] == pytest.approx([far[ids == r["vec_id"]][0] for r in mine], rel=1e-12)
        caught += len({r["vec_id"] for r in mine} & set(ids[order].tolist()))
        whole += len(order)
    assert caught >= 0.9 * whole
