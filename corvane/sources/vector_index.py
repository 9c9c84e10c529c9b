"""An inverted file of vectors with product-quantised residuals, stored in the folders of its lists.

Vectors of unit length (cosine) lie in the list of their nearest coarse centre; what is left of them there is quantised in
SUBSPACES parts, a byte each (Jegou et al. 2011). Centres and code books are fitted in numpy on a bounded sample by hash of
the id (FIT_ROWS vectors, FIT_BYTES); every vector is encoded. A search reads codes of the visited lists only, as the lists are
partitions that the scan prunes, ranks by table look-ups, and reads whole vectors of the candidates alone.

Filters hold before every cut: ids that don't pass take no place among candidates, and lists are visited until as many
that pass were seen as a search without a filter sees at all. Where a filter goes along with the vectors, so that nothing near
the query passes, this can be too few and recall falls; exact=True isn't touched by that. How many lists are visited is
calibrated when the index is built: queries from the sample widen their visits until they find a RECALL part of their true
neighbours.

exact=True gives exact results: each vector's quantisation error and each list's reach bound the cosine by the Cauchy-Schwarz
and triangle inequalities, and whatever may still be among the k best is scored exactly.

Defined results: vectors that are null, of no or another length than most, of norm 0, or that hold nulls or non-finite numbers are never found;
a query of norm 0 or of another length finds nothing; an empty index gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from . import storage

FIT_ROWS, FIT_BYTES, SEED = 50_000, 64 << 20, 3
#: Vectors of a list on average, lists at most, parts of a code, values of a part.
LIST_ROWS, MOST_LISTS, SUBSPACES, VALUES = 1000, 4096, 16, 256
RECALL, CALIBRATE, NEAREST = 0.95, 50, 10
#: Candidates by codes that are scored exactly, for each wanted row.
RERANK = 20


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=len(centres))
        some = held > 0
        centres[some] = sums[some] / held[some, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmin(half - x[a : a + block] @ centres.T, axis=1) for a in range(0, len(x), block)]) if len(x) else np.zeros(0, int)


@dataclass
class Quantiser:
    """centres (lists, width); books (subspaces, values, part's width); width is filled up to a multiple of the subspaces."""

    centres: np.ndarray
    books: np.ndarray
    width: int

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = SUBSPACES, values: int = VALUES) -> Quantiser:
        rng, width = np.random.default_rng(SEED), x.shape[1]
        parts = min(subspaces, width)
        centres = kmeans(x, lists, rng)
        left = cls._filled(x - centres[nearest(x, centres)], parts).reshape(len(x), parts, -1)
        books = [kmeans(left[:, i], values, rng) for i in range(parts)]
        return cls(centres, np.stack([np.vstack([b, np.repeat(b[-1:], values - len(b), 0)]) for b in books]), width)

    @staticmethod
    def _filled(x: np.ndarray, parts: int) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code, length of the code's error and of the whole residual of unit vectors."""
        own, parts = nearest(x, self.centres), len(self.books)
        left = x - self.centres[own]
        cut = self._filled(left, parts).reshape(len(x), parts, -1)
        codes = np.stack([nearest(cut[:, i], self.books[i]) for i in range(parts)], axis=1).astype(np.uint8)
        back = self.books[np.arange(parts)[None], codes].reshape(len(x), -1)
        error = np.sqrt(((cut.reshape(len(x), -1) - back) ** 2).sum(1))
        return own, codes, error, np.sqrt((left * left).sum(1))

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of a query with the centres, and with the values of each part of a code."""
        parts = len(self.books)
        return self.centres @ q, np.einsum("pvw,pw->pv", self.books, self._filled(q[None], parts).reshape(parts, -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def units(points: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    """(id, u): vectors that can be found, at length 1."""
    v = F.col(vec).cast("array<double>")
    rows = points.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("norm", scoring.norm(F.col("v"))).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("u"))


class VectorIndex:
    """Stored: quantiser.json, codes/list=n (id, code, error), vectors/list=n (id, u), lists (list, rows, reach)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = json.loads(storage.read_text(spark, f"{path}/quantiser.json"))
        self.visits, self.width = about["visits"], about["width"]
        self.quantiser = Quantiser(np.array(about["centres"]), np.array(about["books"]), self.width) if about["width"] else None
        self.lists = {r["list"]: (r["rows"], r["reach"]) for r in spark.read.parquet(f"{path}/lists").collect()}  # MOST_LISTS rows at most

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.schema("id long, code binary, error double, list int").parquet(f"{self.path}/codes")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id long, u array<double>, list int").parquet(f"{self.path}/vectors")

    @classmethod
    def build(cls, points: DataFrame, path: str, key: str = "id", vec: str = "vec", lists: int | None = None, recall: float = RECALL) -> VectorIndex:
        """An index of all points under path, in the place of what was there."""
        spark = points.sparkSession
        storage.delete(spark, path)
        units(points, key, vec).write.parquet(f"{path}/units")
        stored = spark.read.parquet(f"{path}/units")
        sizes = stored.groupBy(F.size("u").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
        width, n = (sizes[0]["width"], sizes[0]["count"]) if sizes else (0, 0)
        same = stored.filter(F.size("u") == width)
        about = {"width": width, "visits": 1, "centres": [], "books": []}
        if n:
            lists = lists or max(1, min(MOST_LISTS, n // LIST_ROWS))
            most = max(VALUES, min(FIT_ROWS, FIT_BYTES // (8 * width)))
            sample = same.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
            x = _matrix(sample.column(1).combine_chunks())
            q = Quantiser.fit(x, lists)
            about |= {"centres": q.centres.tolist(), "books": q.books.tolist()}
            sent = spark.sparkContext.broadcast(q)  # of a bounded sample

            def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    own, codes, error, reach = sent.value.encode(_matrix(batch.column(1)))
                    binary = pa.array([c.tobytes() for c in codes], pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch.columns, binary, pa.array(error), pa.array(reach), pa.array(own, pa.int32())], ["id", "u", "code", "error", "reach", "list"])

            coded = same.select("id", "u").mapInArrow(encode, "id long, u array<double>, code binary, error double, reach double, list int")
            coded.write.parquet(f"{path}/coded")
        else:
            spark.createDataFrame([], "id long, u array<double>, code binary, error double, reach double, list int").write.parquet(f"{path}/coded")
        coded = spark.read.schema("id long, u array<double>, code binary, error double, reach double, list int").parquet(f"{path}/coded")
        # by list and hash of the id: a list of most vectors is several files' work
        dealt = coded.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8)))
        dealt.select("id", "code", "error", "list").write.partitionBy("list").parquet(f"{path}/codes")
        dealt.select("id", "u", "list").write.partitionBy("list").parquet(f"{path}/vectors")
        coded.groupBy("list").agg(F.count("*").alias("rows"), F.max("reach").alias("reach")).write.parquet(f"{path}/lists")
        storage.write_text(spark, f"{path}/quantiser.json", json.dumps(about))
        built = cls(spark, path)
        if n:
            built.visits = about["visits"] = built._calibrated(x, sample.column(0).to_numpy(), recall)
            storage.delete(spark, f"{path}/quantiser.json")
            storage.write_text(spark, f"{path}/quantiser.json", json.dumps(about))
        for name in ("units", "coded"):
            storage.delete(spark, f"{path}/{name}")
        return built

    def _calibrated(self, x: np.ndarray, ids: np.ndarray, recall: float) -> int:
        """Lists to visit so that sample queries find a `recall` part of their nearest among all vectors: one scan for all of them."""
        some = np.unique(np.linspace(0, len(x) - 1, CALIBRATE).astype(int))
        queries, own, k = x[some], ids[some], NEAREST
        sent = self.spark.sparkContext.broadcast((queries, own))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, asked_ids = sent.value
            for batch in batches:
                s, found = asked @ _matrix(batch.column(1)).T, batch.column(0).to_numpy()
                s[asked_ids[:, None] == found[None]] = -np.inf
                best = np.argsort(-s, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(asked)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), batch.column(2).take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, 1).ravel())], ["q", "list", "s"])

        from pyspark.sql import Window

        rows = self.vectors.select("id", "u", "list").mapInArrow(scan, "q int, list int, s double")
        best = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).filter(F.col("r") <= k).select("q", "list").collect()  # k rows a query
        if not best:
            return 1
        place = {}
        for i, q in enumerate(queries):
            place[i] = {b: n for n, b in enumerate(self._order(q), 1)}
        places = sorted(place[r["q"]][r["list"]] for r in best)
        return places[min(len(places), int(np.ceil(recall * len(places)))) - 1]

    def _order(self, q: np.ndarray) -> list[int]:
        """Lists that hold vectors, nearest centre first."""
        assert self.quantiser is not None
        far = ((self.quantiser.centres - q) ** 2).sum(1)
        return [int(b) for b in np.argsort(far, kind="stable") if int(b) in self.lists]

    def _query(self, query: list[float]) -> np.ndarray | None:
        q = np.array(query, float)
        if self.quantiser is None or len(q) != self.width or not np.isfinite(q).all() or not (length := np.sqrt(q @ q)) > 0:
            return None
        return q / length

    def approximate(self, q: np.ndarray, visited: list[int], allowed: DataFrame | None) -> DataFrame:
        """(list, id, s, error): inner products by codes of what the visited lists hold and may be found."""
        assert self.quantiser is not None
        central, values = self.quantiser.tables(q)
        rows = self.codes.filter(F.col("list").isin(visited))
        rows = rows if allowed is None else rows.join(allowed.select("id"), "id", "left_semi")

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
                s = central[batch.column(0).to_numpy()] + values[np.arange(len(values))[None], codes].sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), batch.column(3)], ["list", "id", "s", "error"])

        return rows.select("list", "id", "code", "error").mapInArrow(look_up, "list int, id long, s double, error double")

    def _seen(self, visited: list[int], allowed: DataFrame | None) -> int:
        """How many vectors of the visited lists may be found."""
        if allowed is None:
            return sum(self.lists[b][0] for b in visited)
        return self.codes.filter(F.col("list").isin(visited)).select("id").join(allowed.select("id"), "id", "left_semi").count()

    def _scored(self, q: np.ndarray, chosen: DataFrame, lists: list[int]) -> DataFrame:
        """(id, score): cosines of chosen (list, id) rows, which are few, from the lists named."""
        rows = self.vectors.filter(F.col("list").isin(lists)).join(F.broadcast(chosen.select("id")), "id", "left_semi")
        return rows.select("id", F.round(scoring.dot(F.col("u"), q.tolist()), scoring.DIGITS).alias("score"))

    def search(self, query: list[float], k: int, allowed: DataFrame | None = None, visits: int | None = None, exact: bool = False, rerank: int = RERANK) -> DataFrame:
        """(id, score) of the k largest cosines found; allowed: ids that pass a filter."""
        q = self._query(query)
        empty = self.spark.createDataFrame([], "id long, score double")
        if q is None or k < 1 or not self.lists:
            return empty
        order, take = self._order(q), min(len(self.lists), visits or self.visits)
        enough = k if allowed is None else max(k, sum(self.lists[b][0] for b in order[:take]))  # as many as a search without a filter sees
        while take < len(order) and self._seen(order[:take], allowed) < enough:
            take = min(len(order), 2 * take)
        best = self.approximate(q, order[:take], allowed).orderBy(F.desc("s"), "id").limit(rerank * k).collect()
        if not best:
            return empty
        chosen = self.spark.createDataFrame([(r["id"],) for r in best], "id long")
        found = scoring.top_k(self._scored(q, chosen, sorted({r["list"] for r in best})), k, "score", "id")
        if not exact:
            return found
        worst = found.collect()
        least = worst[-1]["score"] - 10.0**-scoring.DIGITS if len(worst) == k else -2.0
        left = self._may_reach(q, least)
        near = self.approximate(q, left, allowed).filter(F.col("s") + F.col("error") + 1e-9 >= least)
        rows = self.vectors.filter(F.col("list").isin(left)).join(near.select("id"), "id", "left_semi")
        return scoring.top_k(rows.select("id", F.round(scoring.dot(F.col("u"), q.tolist()), scoring.DIGITS).alias("score")), k, "score", "id")

    def _may_reach(self, q: np.ndarray, least: float) -> list[int]:
        """Lists that may hold a vector of inner product `least` or more: that of the centre, plus the reach of the list."""
        assert self.quantiser is not None
        central = self.quantiser.centres @ q
        return [b for b, (_, reach) in self.lists.items() if central[b] + reach + 1e-9 >= least]
