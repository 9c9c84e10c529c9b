"""Hard negatives by inner product, searched exactly in a vantage-point tree over norm-augmented vectors.

A vector x gets one more component, the root of M - |x|^2, M being the largest squared norm; an anchor q gets a 0 there. Then
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the best scores are the nearest points, and a window of scores is an annulus around q'.

The tree is fitted in numpy on a bounded sample by hash of the id, which grows with the table: one vector in FIT_SHARE,
between FIT_ROWS and MOST_FIT_ROWS of them and FIT_BYTES at most. A node splits its vectors at the median of their distances
to a vantage point. Every vector is indexed: it goes down the tree to its leaf, and each leaf knows, from all of its vectors,
how near and how far they are from the vantage points above it, and how many it has of each label. By the triangle
inequality these ranges bound the distances, and so the scores, of any anchor to a leaf's vectors.

An anchor goes through the leaves that meet its annulus nearest first, in a priority queue. It stops at first when they
hold enough rows of the wanted kind; the worst of the k best found so far is then a bound of the annulus, and what is left of
the walk takes the leaves that may hold something as good. So results are exact whatever the sample. Positives are searched
like that among the anchor's label, in an annulus that is a ball; then for all windows of its positives at once the
negatives among the other labels.

Equal vectors of one label are one point: only the smallest ids of such a group can be among the first of any result, so
just these are kept in the index, by a window that limits groups before its shuffle. Vectors and anchors of a leaf are dealt
out in blocks of BLOCK_BYTES, and a task compares one block with one block.

Scores are integers: inner products of components turned into floor(scale * x). They are computed in doubles where all sums stay
under 2^53, else in 64-bit integers, which no score exceeds.

Defined results: rows without an id, a label, or a vector, with a null or non-finite component, with a vector of another
length than most (ties: the shorter length) or an empty one, or whose integers' squared norm is over 2^62, take no part; zero
vectors do, and score 0; rows that repeat an id are rows of their own, but are never positives or negatives of an anchor of
their id; they are one anchor, by the smallest label and then the first of their vectors in the order of arrays; a positive or negative
id whose rows would appear twice for an anchor appears once for each of its rows; with fewer positives or negatives than wanted
all are returned; an anchor without positives or negatives has no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ann import deal

POSITIVES, NEGATIVES, SCALE = 5, 5, 256
#: A negative's score in hundredths of the positive's.
LEAST, MOST = 80, 100
FIT_ROWS, FIT_SHARE, MOST_FIT_ROWS, FIT_BYTES = 20_000, 64, 250_000, 64 << 20
#: Sample vectors of a leaf, vantage points tried at a node, bytes of a block of vectors, anchors compared at once.
LEAF, TRIED, BLOCK_BYTES, AT_ONCE = 256, 8, 4 << 20, 256
LARGEST, EXACT = 1 << 62, 1 << 53

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Tree:
    """Nodes in arrays: node i sends what is nearer to its vantage point than radius[i] to near[i], else to far[i]; leaves have -1 there and are numbered.

    low and high: of a node, the distances of its vectors to the vantage points above it, outermost first (measured() fills them in).
    """

    points: np.ndarray
    radius: np.ndarray
    near: np.ndarray
    far: np.ndarray
    leaf: np.ndarray
    path: list[list[int]]
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def depth(self) -> int:
        return max(map(len, self.path))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector and its distances to the vantage points on its way, filled up with nan."""
        at, ways = np.zeros(len(x), np.int64), np.full((len(x), self.depth), np.nan)
        for level in range(self.depth):
            inner = np.flatnonzero(self.near[at] >= 0)
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                d = distances(x[rows], self.points[node])
                ways[rows, level] = d
                at[rows] = np.where(d < self.radius[node], self.near[node], self.far[node])
        return self.leaf[at], ways

    def measured(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> Tree:
        """This tree with the ranges of its leaves (leaves, depth) and their numbers of rows; those of inner nodes follow."""
        n = len(self.leaf)
        lows, highs, held = [np.zeros(0)] * n, [np.zeros(0)] * n, np.zeros(n, np.int64)
        for node in range(n - 1, -1, -1):
            k = len(self.path[node])
            if self.near[node] < 0:
                lows[node], highs[node], held[node] = low[self.leaf[node], :k], high[self.leaf[node], :k], rows[self.leaf[node]]
            else:
                kids = [c for c in (self.near[node], self.far[node]) if held[c]]
                lows[node] = np.min([lows[c][:k] for c in kids], axis=0) if kids else np.zeros(k)
                highs[node] = np.max([highs[c][:k] for c in kids], axis=0) if kids else np.zeros(k)
                held[node] = sum(held[c] for c in kids)
        return Tree(self.points, self.radius, self.near, self.far, self.leaf, self.path, lows, highs, held)

    def walk(self, q: np.ndarray, inner: float = 0.0, outer: float = float("inf")) -> Iterator[tuple[int, float, float]]:
        """(leaf, nearest, farthest) of the leaves that may hold vectors between inner and outer from q, by the bound of the nearest there."""
        queue = [(0.0, 0, float("inf"), ())]
        while queue:
            least, node, most, seen = heapq.heappop(queue)
            if self.near[node] < 0:
                yield int(self.leaf[node]), least, most
                continue
            ways = (*seen, float(distances(q[None], self.points[node])[0]))
            own = np.array(ways)
            for kid in (int(self.near[node]), int(self.far[node])):
                if not self.rows[kid]:
                    continue
                low, high = self.low[kid], self.high[kid]
                nearest = max(least, float(np.max(low - own)), float(np.max(own - high)))
                farthest = min(most, float(np.min(own + high)))
                if nearest <= outer and farthest >= inner:
                    heapq.heappush(queue, (max(nearest, 0.0), kid, farthest, ways))


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(1))


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the component that gives all of them the same norm."""
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0.0))])


def fit(x: np.ndarray, leaf: int, seed: int = 5) -> Tree:
    """Tree over augmented sample vectors. A node's vantage point is, of some tried ones, that whose distances spread most."""
    rng = np.random.default_rng(seed)
    points, radius, near, far, path, rows = [np.zeros(x.shape[1])], [0.0], [-1], [-1], [[]], [np.arange(len(x))]
    i = 0
    while i < len(points):
        own = x[rows[i]]
        if len(own) > leaf:
            tried = [(distances(own, own[j]), own[j]) for j in rng.choice(len(own), min(TRIED, len(own)), replace=False)]
            d, point = max(tried, key=lambda t: t[0].std())
            middle = float(np.median(d))
            middle = middle if (d < middle).any() else float(np.nextafter(middle, np.inf))
            inside = d < middle
            if inside.any() and not inside.all():
                points[i], radius[i], near[i], far[i] = point, middle, len(points), len(points) + 1
                for part in (inside, ~inside):
                    points.append(np.zeros(x.shape[1]))
                    radius.append(0.0)
                    near.append(-1)
                    far.append(-1)
                    path.append([*path[i], i])
                    rows.append(rows[i][part])
        i += 1
    leaves = np.array(near) < 0
    return Tree(np.array(points), np.array(radius), np.array(near), np.array(far), np.where(leaves, np.cumsum(leaves) - 1, -1), path)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integers of a with those of b, exact."""
    if len(a) and len(b) and np.sqrt((a * a).sum(1).max()) * np.sqrt((b * b).sum(1).max()) < EXACT // 2:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def integers(vectors: DataFrame, label: Column, vec_id: str, embedding: str, scale: float = SCALE) -> DataFrame:
    """(id, label, v): rows that take part, v the integers as array<double>."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    return rows.filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) <= float(LARGEST))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass
class Index:
    """Vectors by leaf, the tree with their ranges, and what the leaves hold of each label."""

    rows: DataFrame
    tree: Tree
    largest: float
    width: int
    by_label: dict[int, dict[int, int]]

    @classmethod
    def build(cls, rows: DataFrame, keep: int, fit_rows: int | None = None) -> Index | None:
        """An index of (id, label, v) rows; keep: how many of equal vectors of one label may be asked for. None without rows."""
        sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).orderBy(F.desc("rows"), "n").limit(1).collect()
        if not sizes:
            return None
        width, n, largest = sizes[0]["n"], sizes[0]["rows"], float(sizes[0]["most"])
        same = rows.filter(F.size("v") == width)
        if fit_rows is None:
            fit_rows = min(MOST_FIT_ROWS, max(FIT_ROWS, n // FIT_SHARE), max(LEAF, FIT_BYTES // (8 * (width + 1))))
        sample = same.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()
        tree = fit(augmented(_matrix(sample.column(1).combine_chunks()), largest), LEAF)
        sent = rows.sparkSession.sparkContext.broadcast(tree)  # of a bounded sample

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, ways = sent.value.assign(augmented(_matrix(batch.column(2)), largest))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * ways.shape[1], pa.int32()), pa.array(ways.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *batch.columns, lists], ["leaf", "id", "label", "v", "ways"])

        alike = Window.partitionBy("leaf", "label", "v").orderBy("id")
        again = F.row_number().over(alike) - F.rank().over(alike)  # of rows that repeat an id
        placed = same.select("id", "label", "v").mapInArrow(place, "leaf int, id long, label long, v array<double>, ways array<double>")
        placed = common.cut(placed.withColumn("at", F.dense_rank().over(alike)).withColumn("again", again).filter((F.col("at") <= keep) & (F.col("again") < keep)).drop("at", "again"))
        depth = range(tree.depth)
        ranges = [f(F.get("ways", F.lit(i))).alias(f"{name}{i}") for i in depth for name, f in (("low", F.min), ("high", F.max))]
        low, high, held = np.zeros((int(tree.leaf.max()) + 1, tree.depth)), np.zeros((int(tree.leaf.max()) + 1, tree.depth)), np.zeros(int(tree.leaf.max()) + 1, np.int64)
        for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), *ranges).collect():  # a row a leaf
            held[r["leaf"]] = r["n"]
            low[r["leaf"]], high[r["leaf"]] = ([np.nan if r[f"{name}{i}"] is None else r[f"{name}{i}"] for i in depth] for name in ("low", "high"))
        slack = 1e-9 * (1 + np.sqrt(largest))  # of distances in doubles
        tree = tree.measured(np.nan_to_num(low) - slack, np.nan_to_num(high) + slack, held)
        return cls(placed.drop("ways"), tree, largest, width, _by_label(placed))


def _by_label(placed: DataFrame) -> dict[int, dict[int, int]]:
    """Rows by leaf and label; labels that are too many to list with the leaves are left out, and then don't stop a walk early."""
    counts = placed.groupBy("leaf", "label").agg(F.count("*").alias("n"))
    listed = counts.limit(LISTED + 1).collect()
    if len(listed) > LISTED:
        return {}
    out: dict[int, dict[int, int]] = {}
    for r in listed:
        out.setdefault(r["leaf"], {})[r["label"]] = r["n"]
    return out


#: Pairs of leaf and label that a driver and every task hold at most.
LISTED = 1_000_000


def reached(tree: Tree, q: np.ndarray, largest: float, least: int, most: int) -> Iterator[tuple[int, float]]:
    """(leaf, bound of its highest score) of the leaves that may have scores from least to most, best first."""
    total = float(q @ q) + largest
    slack = 1e-9 * total + 0.5
    far = lambda s: float(np.sqrt(max(0.0, total - 2 * s)))
    for leaf, nearest, _ in tree.walk(np.r_[q, 0.0], far(most + slack), far(least - slack)):
        yield leaf, (total - nearest**2) / 2 + slack


#: Keys of windows, and their least and largest scores, as an anchor brings them.
WINDOWS = ("keys", "low", "high")


def _asks(index: Index, asking: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
    """(leaf, id, v, label, keys, low, high): the leaves that anchors visit, at first or (first=False) after that.

    asking: (id, v, label, keys, low, high, floors, own); floors: by window the worst score of the k best so far, null if there are not k;
    own: rows of the anchor's id, which don't count.
    """
    sent, known, largest = index.rows.sparkSession.sparkContext.broadcast((index.tree, index.by_label)), bool(index.by_label), index.largest

    def held(leaf: int, label: int, counts: dict[int, dict[int, int]]) -> int:
        own = counts.get(leaf, {})
        return own.get(label, 0) if same else sum(own.values()) - own.get(label, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = sent.value
        for batch in batches:
            q = _matrix(batch.column(1))
            labels, lows, highs, floors, owns = (batch.column(i).to_pylist() for i in (2, 4, 5, 6, 7))
            rows, leaves = [], []
            for i in range(len(batch)):
                visited: set[int] = set()
                later: set[int] = set()
                for low, high, floor in zip(lows[i], highs[i], floors[i], strict=True):
                    have, stopped = 0, False
                    for leaf, highest in reached(tree, q[i], largest, low, high):
                        if not stopped:
                            visited.add(leaf)
                            have += held(leaf, labels[i], counts) if known else 0
                            stopped = have >= k + owns[i]
                        elif first or floor is not None and highest < floor:
                            break  # leaves come best first
                        else:
                            later.add(leaf)
                chosen = sorted(visited if first else later - visited)
                rows += [i] * len(chosen)
                leaves += chosen
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), *[batch.column(c).take(at) for c in range(6)]], ["leaf", "id", "v", "label", *WINDOWS])

    return asking.mapInArrow(run, "leaf int, id long, v array<double>, label long, keys array<long>, low array<long>, high array<long>")


def _found(index: Index, walked: DataFrame, same: bool, k: int, block_bytes: int) -> DataFrame:
    """(id, key, found, score): by anchor and window the k best of what each block of its leaves has, of the anchor's label or of others."""
    dealt, asked = deal(index.rows, common.cut(walked), max(1, block_bytes // (8 * index.width)))

    def compare(mine: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        mine = mine.sort_values("id", kind="stable")
        ids, labels = mine["id"].to_numpy(np.int64), mine["label"].to_numpy(np.int64)
        own = np.stack(mine["v"].to_numpy()) if len(mine) else np.zeros((0, 0))
        for a in range(0, len(asks) if len(mine) else 0, AT_ONCE):
            some = asks.iloc[a : a + AT_ONCE]
            table = products(np.stack(some["v"].to_numpy()), own)
            for s, anchor, label, keys, low, high in zip(table, some["id"], some["label"], some["keys"], some["low"], some["high"], strict=True):
                may = np.flatnonzero((ids != anchor) & ((labels == label) == same) & (s >= low.min()) & (s <= high.max()))
                may = may[np.argsort(-s[may], kind="stable")]  # best first, ties by id
                falling = -s[may]
                for key, begin, end in zip(keys, np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right"), strict=True):
                    got = may[begin : min(end, begin + k)]
                    for column, x in zip(out, (np.full(len(got), anchor), np.full(len(got), key), ids[got], s[got]), strict=True):
                        column.append(x)
        return pd.DataFrame(dict(zip(("id", "key", "found", "score"), map(np.concatenate, out), strict=True)))

    return dealt.groupBy("leaf", "a", "b").cogroup(asked.groupBy("leaf", "a", "b")).applyInPandas(compare, "id long, key long, found long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their ranks."""
    order = Window.partitionBy("id", "key").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(index: Index, asking: DataFrame, same: bool, k: int, block_bytes: int) -> DataFrame:
    """(id, key, found, score, rank): exact results of all windows of anchors (id, v, label, keys, low, high, own), in two steps of their walks."""
    own = ("id", "v", "label", *WINDOWS)
    asking = common.cut(asking)
    none = F.transform("keys", lambda x: F.lit(None).cast("long"))
    begun = common.cut(_best(_found(index, _asks(index, asking.select(*own, none.alias("floors"), "own"), same, k, True), same, k, block_bytes), k))
    worst = begun.filter(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("at"))  # as many as windows
    floors = F.transform("keys", lambda key: F.element_at(F.coalesce("at", F.create_map().cast("map<bigint,bigint>")), key))
    known = asking.join(worst, "id", "left").select(*own, floors.alias("floors"), "own")
    more = _found(index, _asks(index, known, same, k, False), same, k, block_bytes)
    return _best(begun.drop("rank").unionByName(more), k)


def _hundredths(score: Column, share: int, up: bool) -> Column:
    """share hundredths of a whole number, rounded up or down, without a product that may overflow for shares up to 100."""
    rest = F.pmod(score, F.lit(100))
    part = F.lit(share) * rest
    return F.call_function("div", score - rest, F.lit(100)) * share + F.call_function("div", part + (99 if up else 0), F.lit(100))


def mine(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE, fit_rows: int | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For the anchors, for which is_anchor(id column) holds, and each of their best positives, the best negatives whose scores are from least to most hundredths of the positive's.

    label: an expression for another label than the column `label`.
    """
    spark = vectors.sparkSession
    rows = common.cut(integers(vectors, F.col("label") if label is None else label, vec_id, embedding, scale))
    keep = max(positives, negatives) + 1
    index = Index.build(rows, keep, fit_rows)
    if index is None:
        return spark.createDataFrame([], RESULT)
    anchors = rows.filter(is_anchor(F.col("id")) & (F.size("v") == index.width)).groupBy("id").agg(F.min(F.struct("label", "v")).alias("one"), F.count("*").alias("own"))
    anchors = common.cut(anchors.select("id", F.col("one.v").alias("v"), F.col("one.label").alias("label"), F.least("own", F.lit(keep)).alias("own")))
    whole = [F.array(F.lit(x).cast("long")).alias(name) for name, x in zip(WINDOWS, (0, -LARGEST, LARGEST), strict=True)]
    best = _search(index, anchors.select("id", "v", "label", *whole, "own"), True, positives, block_bytes)
    best = common.cut(best.select(F.col("id").alias("anchor_id"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score")
    windows = best.select(F.col("anchor_id").alias("id"), score.alias("key"), _hundredths(score, least, True).alias("low"), _hundredths(score, most, False).alias("high"))
    windows = windows.filter("low <= high").distinct().groupBy("id").agg(F.collect_list(F.struct("key", "low", "high")).alias("w"))  # as many as positives
    arrays = [F.col(f"w.{name}").alias(many) for many, name in zip(WINDOWS, ("key", "low", "high"), strict=True)]
    found = _search(index, anchors.join(windows, "id").select("id", "v", "label", *arrays, "own"), False, negatives, block_bytes)
    found = found.select(F.col("id").alias("anchor_id"), F.col("key").alias("positive_score"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
