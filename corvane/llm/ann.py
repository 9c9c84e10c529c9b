"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted in numpy on a bounded sample by hash of the id, which grows with the table: one vector in FIT_SHARE,
between FIT_ROWS and MOST_FIT_ROWS of them, and FIT_BYTES at most. Every vector is indexed: it goes down the tree to its leaf. A query walks the
tree with a priority queue of branches, nearest centre first, which gives its leaves in the order in which it would visit
them. How many leaves to visit is calibrated: for CALIBRATE sample queries the true neighbours are found by a scan of all
vectors, and the number of visits widens until the share of them that lie in visited leaves reaches the wanted recall. A
walk goes on beyond that while its leaves hold too few candidates.

Both the vectors and the queries of a leaf are dealt out in blocks of BLOCK_BYTES by hash of the id, and a task compares one
block with one block: a leaf that holds a third of all vectors, or that most queries visit, is many tasks' work. Every
pair of blocks gives its own nearest to a query, and those are merged by query. Distances are computed from the differences
in double precision, in one order, so equal vectors tie exactly; squares beyond the range of doubles are avoided by a scale.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows without an id; rows that repeat an id count as candidates of their own, but never for a query
of the same id; they are one query, by the first of their vectors in the order of arrays; a distance too large for a double
is infinite and comes last; with fewer candidates than k all are returned; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

NEAREST = 10
FIT_ROWS, FIT_SHARE, MOST_FIT_ROWS, FIT_BYTES = 20_000, 64, 250_000, 128 << 20
#: Distances below which squares may have lost digits.
TINY = 1e-140
CALIBRATE, RECALL = 100, 0.97
#: Children of a node, sample vectors in a leaf, bytes of a block of vectors, vectors and queries compared at once.
BRANCH, LEAF, BLOCK_BYTES, BLOCK, AT_ONCE = 8, 64, 4 << 20, 2_000, 64


@dataclass
class Tree:
    """Nodes in arrays: children of node i are first[i] .. first[i] + count[i] - 1; leaves have none and are numbered."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.count[at] > 0)
            if not len(inner):
                return self.leaf[at]
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                kids = np.arange(self.first[node], self.first[node] + self.count[node])
                at[rows] = kids[np.argmin(_squares(x[rows], self.centres[kids]), axis=1)]

    def visit(self, q: np.ndarray, most: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first leaves of a best-bin-first walk: `most`, and more until they hold `need` vectors. held: vectors by leaf."""
        out, queue, have = [], [(0.0, 0)], 0
        while queue and (len(out) < most or have < need):
            _, node = heapq.heappop(queue)
            if self.count[node] == 0:
                leaf = int(self.leaf[node])
                out.append(leaf)
                have += need if held is None else int(held[leaf])
                continue
            kids = range(self.first[node], self.first[node] + self.count[node])
            for far, kid in zip(((self.centres[kids.start : kids.stop] - q) ** 2).sum(1).tolist(), kids, strict=True):
                heapq.heappush(queue, (far, kid))
        return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1)[None] - 2 * (x @ c.T)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin(_squares(x, centres), axis=1)
        for j in range(k):
            if (rows := own == j).any():
                centres[j] = x[rows].mean(0)
    own = np.argmin(_squares(x, centres), axis=1)
    used, own = np.unique(own, return_inverse=True)
    return centres[used], own


def fit(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 11) -> Tree:
    """Tree over sample vectors; a node is split while it holds more than leaf vectors that differ."""
    rng = np.random.default_rng(seed)
    centres, first, count, rows = [x.mean(0) if len(x) else np.zeros(0)], [0], [0], [np.arange(len(x))]
    i = 0
    while i < len(centres):
        own = x[rows[i]]
        if len(own) > leaf and (own != own[0]).any():
            c, of = _kmeans(own, min(branch, len(own)), rng)
            if len(c) > 1:
                first[i], count[i] = len(centres), len(c)
                for j in range(len(c)):
                    centres.append(c[j])
                    first.append(0)
                    count.append(0)
                    rows.append(rows[i][of == j])
        i += 1
    counts = np.array(count)
    numbers = np.where(counts == 0, np.cumsum(counts == 0) - 1, -1)
    return Tree(np.array(centres), np.array(first), counts, numbers)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to q. Where squares leave the range of doubles, differences are divided by the largest one before they are squared."""
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt(((x - q) ** 2).sum(1))
        odd = np.flatnonzero(~np.isfinite(d) | (d < TINY))
        if len(odd):
            gaps = np.abs(x[odd] - q)
            most = gaps.max(1)
            some = np.isfinite(most) & (most > 0)
            d[odd] = most
            d[odd[some]] = most[some] * np.sqrt(((gaps[some] / most[some, None]) ** 2).sum(1))
    return d


def nearest(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's position, id, distance) of the k nearest of x to each query, ties to smaller ids, without the query's own id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, (q, own) in enumerate(zip(queries, query_ids, strict=True)):
        d = distances(x, q)
        some = np.flatnonzero(ids != own)
        if len(some) > k:
            limit = np.partition(d[some], k - 1)[k - 1]
            some = some[d[some] <= limit]
        some = some[np.lexsort((ids[some], d[some]))][:k]
        out.append((np.full(len(some), i), ids[some], d[some]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))  # type: ignore[return-value]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): vectors that take part, as array<double>."""
    v = F.col(embedding).cast("array<double>")
    good = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return good.filter(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among partial results."""
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact (query_id, rank, vec_id, score) for a bounded set of queries: every task compares its rows with all of them, in blocks."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = sent.value
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                at, got, far = nearest(q, q_ids, _matrix(part.column(1)), part.column(0).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at], pa.int64()), pa.array(got, pa.int64()), pa.array(far, pa.float64())], ["query_id", "vec_id", "score"])

    return _merge(rows.mapInArrow(run, "query_id long, vec_id long, score double"), k)


def deal(indexed: DataFrame, walked: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries (leaf, id, v) with the numbers (a, b) of their blocks, so that every vector meets every query of its leaf in one (leaf, a, b), which about `most` of each share."""
    blocks = lambda side, name: side.groupBy("leaf").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    both = F.broadcast(common.cut(blocks(indexed, "mine").join(blocks(walked, "theirs"), "leaf")))  # a row for each leaf of a tree of bounded size
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = indexed.join(both, "leaf").withColumn("a", part("mine")).withColumn("b", every("theirs")).drop("mine", "theirs")
    asked = walked.join(both, "leaf").withColumn("b", part("theirs")).withColumn("a", every("mine")).drop("mine", "theirs")
    return dealt, asked


def search(vectors: DataFrame, is_query, k: int = NEAREST, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding", fit_rows: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): k near neighbours of the rows for which is_query(id column) holds, among all others."""
    spark = vectors.sparkSession
    all_rows = usable(vectors, vec_id, embedding)
    sizes = all_rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    width = sizes[0]["n"]
    rows = all_rows.filter(F.size("v") == width)
    if fit_rows is None:
        fit_rows = min(MOST_FIT_ROWS, max(FIT_ROWS, sizes[0]["count"] // FIT_SHARE), max(LEAF, FIT_BYTES // (8 * width)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()
    sample_ids, x = sample.column(0).combine_chunks().to_numpy(), _matrix(sample.column(1).combine_chunks())
    tree = fit(x)
    sent = spark.sparkContext.broadcast(tree)

    # calibrate the visits: at which place of a query's walk lie the leaves of its true neighbours
    some = np.unique(np.linspace(0, len(x) - 1, CALIBRATE).astype(int))
    q_ids, first = np.unique(sample_ids[some], return_index=True)
    q = x[some][first]
    truth = scan(rows, q_ids, q, k).select("query_id", F.col("vec_id").alias("id"))
    near = rows.join(F.broadcast(truth), "id").select("query_id", "v").toArrow()  # k rows a query
    visits = 1
    if len(near):
        leaf = tree.assign(_matrix(near.column(1).combine_chunks()))
        place = {i: {b: n for n, b in enumerate(tree.visit(v, tree.leaves), 1)} for i, v in zip(q_ids.tolist(), q, strict=True)}
        places = np.sort([place[i][int(b)] for i, b in zip(near.column(0).to_pylist(), leaf, strict=True)])
        visits = int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.assign(_matrix(batch.column(1))), pa.int32()), batch.column(0), batch.column(1)], ["leaf", "id", "v"])

    indexed = common.cut(rows.mapInArrow(index, "leaf int, id long, v array<double>"))
    counts = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a row for each leaf of a tree of bounded size
    held = np.array([counts.get(i, 0) for i in range(tree.leaves)])
    known = spark.sparkContext.broadcast(held)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [sent.value.visit(v, visits, known.value, k + own) for v, own in zip(_matrix(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            rows_ = np.repeat(np.arange(len(batch)), list(map(len, leaves)))
            yield pa.RecordBatch.from_arrays([pa.array([b for own in leaves for b in own], pa.int32()), batch.column(0).take(pa.array(rows_)), batch.column(1).take(pa.array(rows_))], ["leaf", "id", "v"])

    asking = rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    walked = common.cut(asking.mapInArrow(walk, "leaf int, id long, v array<double>"))
    dealt, asked = deal(indexed, walked, max(1, block_bytes // (8 * width)))

    def compare(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(queries):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        own_ids, own, ids_ = mine["id"].to_numpy(np.int64), np.stack(mine["v"].to_numpy()), queries["id"].to_numpy(np.int64)
        parts = []
        for a in range(0, len(queries), AT_ONCE):
            asks, ask_ids = np.stack(queries["v"].iloc[a : a + AT_ONCE].to_numpy()), ids_[a : a + AT_ONCE]
            best = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
            for c in range(0, len(own), BLOCK):  # pieces that stay in the processor's cache
                at, got, far = nearest(asks, ask_ids, own[c : c + BLOCK], own_ids[c : c + BLOCK], k)
                best = tuple(np.concatenate(p) for p in zip(best, (at, got, far), strict=True))
            at, got, far = best
            order = np.lexsort((got, far, at))
            at, got, far = at[order], got[order], far[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            parts.append(pd.DataFrame({"query_id": ask_ids[at], "vec_id": got, "score": far})[place < k])
        return pd.concat(parts)

    found = dealt.groupBy("leaf", "a", "b").cogroup(asked.groupBy("leaf", "a", "b")).applyInPandas(compare, "query_id long, vec_id long, score double")
    return _merge(found, k)
