"""Scores of ranked search. Definitions: cosine in double precision; BM25 after Robertson and Zaragoza (2009) with idf
ln((N - df + 0.5) / (df + 0.5) + 1); reciprocal rank fusion after Cormack et al. (2009)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60
#: Decimals of a score before rows are ordered, so that equal rows tie.
DIGITS = 6


def _blocks(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of v that are vectors of one length without nulls, the most frequent length, and their matrix in double precision."""
    sizes = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    values, counts = np.unique(sizes[sizes >= 0], return_counts=True)
    rows = np.flatnonzero(sizes == (values[np.argmax(counts)] if len(values) else -2))
    taken = v.take(pa.array(rows)) if len(rows) < len(v) else v
    flat = taken.flatten()
    return rows, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def _by_rows(v: pa.Array, of) -> pa.Array:
    """of(matrix) for vectors of each length in turn."""
    out, left = np.full(len(v), np.nan), np.arange(len(v))
    known = np.zeros(len(v), bool)
    while len(left):
        part = v.take(pa.array(left)) if len(left) < len(v) else v
        rows, x = _blocks(part)
        if not len(rows):
            break
        fine = ~np.isnan(x).any(1) if part.flatten().null_count else np.ones(len(x), bool)
        out[left[rows[fine]]] = of(x[fine])
        known[left[rows[fine]]] = True
        left = np.delete(left, rows)
    return pa.array(out, pa.float64(), mask=~known)


def norm(v: Column) -> Column:
    """Length of a vector in double precision; null for a null or one that holds a null."""

    @F.arrow_udf("double")
    def length(v: pa.Array) -> pa.Array:
        return _by_rows(v, lambda x: np.sqrt((x * x).sum(1)))

    return length(v)


def dot(v: Column, q: list[float]) -> Column:
    """Inner product with a given vector, a block of vectors at a time; null for a vector of another length."""
    query = np.array(q, np.float64)

    @F.arrow_udf("double")
    def product(v: pa.Array) -> pa.Array:
        return _by_rows(v, lambda x: x @ query if x.shape[1] == len(query) else np.full(len(x), np.nan))

    return F.nanvl(product(v), F.lit(None).cast("double"))


def cosine(v: Column, q: list[float], v_norm: Column | None = None) -> Column:
    """Cosine with a given query; null where either has no length. v_norm: a stored norm of v."""
    q_norm = sum(float(x) ** 2 for x in q) ** 0.5
    length = norm(v) if v_norm is None else v_norm
    return F.when((length > 0) & F.lit(q_norm > 0), dot(v, q) / (length * F.lit(q_norm or 1.0)))


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf(df, n) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def top_k(scored: DataFrame, k: int, score: str = "score", *ties: str) -> DataFrame:
    """k best rows; null scores are left out."""
    return scored.filter(F.col(score).isNotNull()).orderBy(F.desc(score), *ties).limit(k)


def ranked(scored: DataFrame, score: str, *ties: str) -> DataFrame:
    """A rank from 1 over few rows, such as a branch's best."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *ties)))


def rrf(branches: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Fused score of rows by key from branches with a rank."""
    lists = [b.select(key, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part")) for b in branches]
    return reduce(DataFrame.unionByName, lists).groupBy(key).agg(F.sum("part").alias("score"))
