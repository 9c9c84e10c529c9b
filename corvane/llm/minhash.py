"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct word shingles. Signatures follow C-MinHash (Li and Li 2022): a first permutation
scatters the shingles over the universe, and one second permutation, shifted circularly by k, gives coordinate k. Both
are bijections of 32-bit numbers. Bands of coordinates make candidates, full sets confirm them.

Work stays near linear in large groups. Documents with equal sets form one class, which goes on as one node under a
number of its own. A set whose shingles are mostly its own has no partner, whatever it meets in buckets; an exact bound on the
intersection, from the count of shingles that it shares with any other set, takes such sets and pairs out. In a bucket,
every member is first compared with the one that meets most others. What such links don't join is compared across the
components that meet in a bucket: members outside of its largest component against all members of other components,
by an exact prefix filter. So every candidate link between different components is verified or ruled out, and none inside a component is needed.

With ROWS = 4 and BANDS = 32, a pair at the threshold of 0.75 misses all bands with probability 5e-6.

Defined results: a null or empty text has the empty set, n_shingles 0, and is linked with nothing; a text of fewer words
than a shingle is one shingle; rows of one doc_id are one document of the graph: whatever their texts, they are linked with
each other and share their links, but for those without text; a row of null doc_id keeps its n_shingles, has a null
component_id and is kept; an empty table gives an empty table; dedup() adds no column, and all columns pass through it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph
from .words import Remembered, portions

SHINGLE, BANDS, ROWS = 5, 32, 4
#: The threshold as a fraction of integers, so that it is exact.
PART, WHOLE = 75, 100
#: Bytes of text taken at once.
PORTION = 1 << 20

#: Lower-cases A-Z and maps the other white space to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


def fmix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of uint32."""
    x = x ^ np.uint32(seed)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


class Words(Remembered):
    def __init__(self):
        super().__init__(xxhash.xxh3_64_intdigest)


def shingle_sets(texts: list[bytes], words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    split = [t.translate(FOLD).split() for t in texts]
    flat = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.uint64, sum(map(len, split)))
    n = len(flat)
    if n >= size:
        grams = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            grams += fmix64(flat[j : n - size + 1 + j] + np.uint64(j)) * np.uint64(MULTIPLIERS[j % len(MULTIPLIERS)] + 2 * (j // len(MULTIPLIERS)))
        grams = fmix64(grams)
    out, at = [], 0
    for s in split:
        if len(s) >= size:
            out.append(np.unique(grams[at : at + len(s) - size + 1]))
        elif s:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\x00short " + b" ".join(s))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(s)
    return out


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64-bit band hashes (sets, bands) of the circulant signatures; sets are not empty."""
    sizes = np.array(list(map(len, sets)))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = permute(fmix64(np.concatenate(sets)).astype(np.uint32), 0x5BD1E995)
    # a block of sets at a time, so that the block stays in the processor's cache
    out, a = np.empty((len(sets), bands), np.uint64), 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + (1 << 15))))
        part, cuts = x[starts[a] : starts[b - 1] + sizes[b - 1]], starts[a:b] - starts[a]
        for band in range(bands):
            key = np.full(b - a, 0x9E3779B97F4A7C15 * (band + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for r in range(rows):
                least = np.minimum.reduceat(permute(part + np.uint32(band * rows + r), 0x2545F491), cuts)
                key = fmix64(key ^ least.astype(np.uint64))
            out[a:b, band] = key
        a = b
    return out


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in batches:
        for start, texts in portions(batch.column(1), PORTION):
            yield batch.column(0).slice(start, len(texts)), texts


def sketch(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, bands): the set's size, its 128-bit hash, its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for ids, texts in _portions(batches):
            sets = shingle_sets(texts, words, size)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), bands), np.int64)
            if full:
                keys[full] = signatures([sets[i] for i in full], bands, rows).view(np.int64)
            digests = np.array(list(map(_digest, sets)), np.int64).reshape(-1, 2)
            has = np.array([bool(len(s)) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(has, bands, 0))], pa.int32()), pa.array(keys[has].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, sets)), pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists], ["doc_id", "n_shingles", "hi", "lo", "bands"])

    return _source(docs).mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def sets_of(chosen: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, shingles): the whole sets of (node, hi, lo, text) rows whose text has the set of that hash, once a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            nodes, hi, lo = (batch.column(i).to_pylist() for i in range(3))
            for start, texts in portions(batch.column(3), PORTION):
                got, sets = [], []
                for i, s in enumerate(shingle_sets(texts, words, size), start):
                    if nodes[i] not in seen and _digest(s) == (hi[i], lo[i]):
                        seen.add(nodes[i])
                        got.append(nodes[i])
                        sets.append(s)
                if got:
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(list(map(len, sets)))], pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), lists], ["node", "shingles"])

    return chosen.select("node", "hi", "lo", common.text_bytes().alias("text")).mapInArrow(run, "node long, shingles array<long>")


def _digest(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit hash in two signed halves."""
    return struct.unpack(">qq", xxhash.xxh3_128_digest(s.tobytes()))


def verify(pairs: DataFrame, sets: DataFrame, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """The (a, b) of pairs whose sets are similar enough. Sets come together by shuffles on a, then on b; a key with many pairs can be split."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    n = F.size(F.array_intersect("sa", "sb"))
    near = (F.least(F.size("sa"), F.size("sb")) * whole >= F.greatest(F.size("sa"), F.size("sb")) * part) & (n * whole >= (F.size("sa") + F.size("sb") - n) * part)
    return both.filter(near).select("a", "b")


def sharing(sets: DataFrame, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """(node, n, c) of the sets that can have a partner: n their size, c how many of their shingles another set holds too.

    No intersection is larger than c, so a set with too small a part of shared shingles has no partner at all.
    """
    once = sets.select("node", F.explode_outer("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("node").alias("node")).filter("k = 1")
    alone = once.groupBy("node").agg(F.count("*").alias("u"))
    sized = sets.select("node", F.size("shingles").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c"))
    return sized.filter(F.col("c") * whole >= F.col("n") * part)


def _feasible(c: Column, n: Column, m: Column, part: int = PART, whole: int = WHOLE) -> Column:
    """Whether sets of n and m shingles are similar enough if they share c."""
    return c * (part + whole) >= (n + m) * part


def crossing(nodes: DataFrame, sets: DataFrame, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """(a, b), a < b: all pairs of nodes (node, n, root, least, rest) that may be similar enough, of different roots, one of them in rest.

    Prefix filter (Bayardo et al. 2007): in one order of all shingles, rarest first, similar sets share one of their first
    n - t + 1, t being the least intersection. So copies that a common text makes alike meet only where they share
    what is rare. least: the size of a node's smallest partner.
    """
    own = sets.join(common.small(nodes), "node")
    each = own.select("node", "n", "root", "least", "rest", F.explode_outer("shingles").alias("s"))
    rarity = each.groupBy("s").agg(F.count("*").alias("k")).filter("k > 1")
    # shingles of one set come first in its order; they are counted, not listed
    listed = each.join(rarity, "s").withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("k", "s")))
    alone = each.join(rarity, "s", "left_anti").groupBy("node").agg(F.count("*").alias("u"))
    smallest = F.greatest(F.col("least") * whole, F.col("n") * part) / whole
    ranked = listed.join(common.small(common.cut(alone)), "node", "left").withColumn("i", F.col("i") + F.coalesce("u", F.lit(0)))
    ranked = ranked.filter(F.col("i") <= F.col("n") - F.ceil((F.col("n") + smallest) * part / (part + whole)) + 1)
    ranked = common.cut(ranked.select("s", "node", "n", "root", "rest", "i"))
    a = ranked.filter("rest = 1").select("s", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("i").alias("ia"))
    b = ranked.select("s", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("i").alias("ib"))
    t = F.ceil((F.col("na") + F.col("nb")) * part / (part + whole))
    near = (F.col("ia") <= F.col("na") - t + 1) & (F.col("ib") <= F.col("nb") - t + 1) & (F.least("na", "nb") * whole >= F.greatest("na", "nb") * part)
    met = a.join(b, (a["s"] == b["s"]) & (F.col("ra") != F.col("rb")) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes_of(sketched: DataFrame) -> DataFrame:
    """(hi, lo, node, rep, bands, n) of each class of equal sets: a number of its own, its smallest id, its documents. Materialised, for the numbers hold for one computation."""
    full = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    return common.cut(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))


def same_id(sketched: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(a, b): links between the classes that hold one doc_id, each with the first of them; None if no id has two sets."""
    held = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "hi", "lo")
    bounds = held.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("hi", "lo")])
    several = common.cut(bounds.filter("min_hi < max_hi OR min_lo < max_lo").select("doc_id"))
    if several.isEmpty():
        return None
    each = held.join(common.small(several), "doc_id").join(classes.select("hi", "lo", "node"), ["hi", "lo"]).select("doc_id", "node").distinct()
    each = common.cut(each)
    first = each.groupBy("doc_id").agg(F.min("node").alias("b"))
    return common.cut(each.withColumnRenamed("node", "a").join(first, "doc_id").filter("a <> b").select("a", "b").distinct())


def components(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs."""
    sketched = common.cut(sketch(docs, size, bands, rows))
    classes = classes_of(sketched)
    banded = classes.select("node", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band")
    members = common.cut(banded.join(met, "band").select("band", "node"))
    # whole sets of candidates only, and of these only what can have a partner in its bucket
    met = members.select("node").distinct()
    wanted = common.cut(classes.select("node", "rep", "hi", "lo").join(met, "node", "left_semi"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(common.small(wanted), "rep")
    sets = common.cut(sets_of(texts, size))
    if sets.count() > wanted.count():  # tasks saw rows that repeat a document
        sets = common.cut(sets.dropDuplicates(["node"]))
    live = members.join(common.small(common.cut(sharing(sets))), "node")
    buckets = live.groupBy("band").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1")
    partner = F.greatest(F.col("least") * WHOLE, F.col("n") * PART)  # times WHOLE: the smallest partner's size
    live = live.join(buckets, "band").filter(F.col("c") * (PART + WHOLE) * WHOLE >= (F.col("n") * WHOLE + partner) * PART)
    live = common.cut(live.select("band", "node", "n", "c", "k"))
    # the member that meets most others is a bucket's star: an original rather than one of its copies
    central = live.groupBy("node").agg(F.sum("k").alias("met"))
    placed = common.cut(live.join(central, "node").select("band", "node", "n", "c", "met"))
    stars = placed.groupBy("band").agg(F.max(F.struct("met", "n", "c", "node")).alias("s")).select("band", F.col("s.node").alias("star"), F.col("s.n").alias("m"), F.col("s.c").alias("d"))
    first = placed.join(stars, "band").filter(F.col("node") != F.col("star")).filter(_feasible(F.least("c", "d"), F.col("n"), F.col("m")))
    first = common.cut(first.select(F.col("node").alias("a"), F.col("star").alias("b")).distinct())
    links = common.cut(verify(first, sets))
    found = graph.components(links, "a", "b")
    # links that may still join components which meet in a bucket
    placed = placed.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = placed.groupBy("band", "root").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    largest = per.groupBy("band").agg(F.max(F.struct("k", "root")).getField("root").alias("top"), F.min("least").alias("least"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    mixed = placed.join(largest, "band").groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.min("least").alias("least"), F.max((F.col("root") != F.col("top")).cast("int")).alias("rest"))
    cross = crossing(common.cut(mixed), sets)
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = common.cut(verify(cross.join(tried, ["a", "b"], "left_anti"), sets))
    again = same_id(sketched, classes)
    new = [x for x in (None if more.isEmpty() else more, again) if x is not None]
    roots = graph.components(reduce(DataFrame.unionByName, new, links), "a", "b") if new else found
    joined = classes.select("hi", "lo", "node", "rep", "n").join(roots, "node", "left").filter("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    final = common.cut(joined.select("hi", "lo", "root", "rep"))
    least = final.groupBy("root").agg(F.min("rep").alias("component"))
    final = common.cut(final.join(least, "root").select("hi", "lo", "component"))
    out = sketched.select("doc_id", "n_shingles", "hi", "lo").join(common.small(final), ["hi", "lo"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each component: the one of smallest doc_id, and of rows that repeat it the first as JSON.

    The rows to drop are few and known by id; they reach the documents by a broadcast if their size allows.
    """
    found = common.cut(components(docs).filter("n_shingles > 0 AND doc_id IS NOT NULL"))
    drop = common.cut(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    repeated = common.cut(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    said = F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")  # what says nothing is linked with nothing
    gone = common.small(drop.withColumnRenamed("doc_id", "__gone"))
    kept = docs.join(gone, (docs["doc_id"].cast("long") == F.col("__gone")) & said, "left_anti")
    if repeated.isEmpty():
        return kept.select(*names)
    again = common.small(repeated.withColumnRenamed("doc_id", "__again"))
    same = (docs["doc_id"].cast("long") == F.col("__again")) & said
    row = F.struct(*names)
    one = kept.join(again, same).groupBy("__again").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return kept.join(again, same, "left_anti").select(*names).unionByName(one)
