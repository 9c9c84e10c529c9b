"""Points of several vectors, found by their largest cosine without reading all vectors.

Vectors of unit length lie in the list of their nearest centre, each with its distance from it (its reach), lists being
partitions that the scan prunes. By the Cauchy-Schwarz inequality no vector is nearer to a query than its centre's inner product plus its
reach. A search scores the nearest lists until they hold k points, which gives a least score; a point of that score or more has a
vector of that bound or more, so only lists and vectors that can reach it are read, and the result is exact.

Centres are fitted in numpy on a bounded sample by hash of the id (vector_index.FIT_ROWS, FIT_BYTES); every vector is in a list.

Defined results: as of vector_index; points all of whose vectors can't be found are never found, points that repeat have all their vectors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from . import storage, vector_index

SCHEMA = "id long, u array<double>, reach double, list int"


class LateIndex:
    """Stored: centres.json, vectors/list=n (id, u, reach), lists (list, rows, reach)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.centres = np.array(json.loads(storage.read_text(spark, f"{path}/centres.json")), float)
        self.lists = {r["list"]: (r["rows"], r["reach"]) for r in spark.read.parquet(f"{path}/lists").collect()}  # MOST_LISTS rows at most

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/vectors")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "id", vec: str = "vec", lists: int | None = None) -> LateIndex:
        """An index of all rows of vectors under path, in the place of what was there."""
        spark = vectors.sparkSession
        storage.delete(spark, path)
        vector_index.units(vectors, key, vec).write.parquet(f"{path}/units")
        stored = spark.read.parquet(f"{path}/units")
        sizes = stored.groupBy(F.size("u").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
        width, n = (sizes[0]["width"], sizes[0]["count"]) if sizes else (0, 0)
        centres = np.zeros((0, 0))
        if n:
            most = min(vector_index.FIT_ROWS, max(1, vector_index.FIT_BYTES // (8 * width)))
            sample = stored.filter(F.size("u") == width).orderBy(F.xxhash64("id", "u")).limit(most).select("u").toArrow()
            x = vector_index._matrix(sample.column(0).combine_chunks())
            centres = vector_index.kmeans(x, lists or max(1, min(vector_index.MOST_LISTS, n // vector_index.LIST_ROWS)), np.random.default_rng(vector_index.SEED))
        sent = spark.sparkContext.broadcast(centres)  # MOST_LISTS at most

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = vector_index._matrix(batch.column(1))
                own = vector_index.nearest(x, sent.value)
                reach = np.sqrt(((x - sent.value[own]) ** 2).sum(1)) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach), pa.array(own, pa.int32())], ["id", "u", "reach", "list"])

        same = stored.filter(F.size("u") == width).select("id", "u")
        # by list and hash of the id: a list of most vectors is several files' work
        same.mapInArrow(place, SCHEMA).repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/vectors")
        spark.read.schema(SCHEMA).parquet(f"{path}/vectors").groupBy("list").agg(F.count("*").alias("rows"), F.max("reach").alias("reach")).write.parquet(f"{path}/lists")
        storage.write_text(spark, f"{path}/centres.json", json.dumps(centres.tolist()))
        storage.delete(spark, f"{path}/units")
        return cls(spark, path)

    def search(self, query: list[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(id, score) of the k points of the largest cosine; allowed: ids that pass a filter."""
        q = np.array(query, float)
        usable = len(self.lists) and len(q) == self.centres.shape[1] and np.isfinite(q).all() and q @ q > 0
        if not usable or k < 1:
            return self.spark.createDataFrame([], "id long, score double")
        q = q / np.sqrt(q @ q)
        least = self._least(q, k, allowed)
        return scoring.top_k(self._best(q, self.may_reach(q, least), least, allowed), k, "score", "id")

    def may_reach(self, q: np.ndarray, least: float) -> list[int]:
        """Lists that may hold a vector of inner product `least` or more with the unit vector q."""
        central = self.centres @ q
        return sorted(b for b, (_, reach) in self.lists.items() if central[b] + reach + 1e-9 >= least)

    def _least(self, q: np.ndarray, k: int, allowed: DataFrame | None) -> float:
        """A score that k points reach, from the lists nearest to q, twice as many at a time until they hold k points; -2 if there are fewer."""
        order = [int(b) for b in np.argsort(-(self.centres @ q), kind="stable") if int(b) in self.lists]
        take = 1
        while True:
            if take == len(order) or sum(self.lists[b][0] for b in order[:take]) >= k:
                got = scoring.top_k(self._best(q, order[:take], -2.0, allowed), k, "score", "id").collect()
                if len(got) == k:
                    return got[-1]["score"] - 10.0**-scoring.DIGITS
                if take == len(order):
                    return -2.0
            take = min(len(order), 2 * take)

    def _best(self, q: np.ndarray, lists: list[int], least: float, allowed: DataFrame | None) -> DataFrame:
        """(id, score): the largest cosine of each point among vectors of the lists that may reach `least`."""
        central = self.centres @ q
        rows = self.vectors.filter(F.col("list").isin(lists))
        if least > -2.0:  # a list's own bound for each of its vectors: those that are too near their centre are never scored
            needed = F.element_at(F.create_map(*[F.lit(v) for b in lists for v in (int(b), float(least - central[b] - 1e-9))]), F.col("list")) if lists else F.lit(0.0)
            rows = rows.filter(F.col("reach") >= needed)
        rows = rows if allowed is None else rows.join(allowed.select("id"), "id", "left_semi")
        best = rows.select("id", scoring.dot(F.col("u"), q.tolist()).alias("s")).groupBy("id").agg(F.max("s").alias("s"))
        return best.select("id", F.round("s", scoring.DIGITS).alias("score"))
