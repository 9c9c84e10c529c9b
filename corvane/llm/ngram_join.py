"""N-gram Jaccard join by rare-first prefix filtering, with length, positional and suffix filters.

A document's set holds its distinct word shingles. Documents of equal sets form one class (its number of documents doesn't
matter any more). All shingles stand in one global order, rarest first: how often each occurs is counted over all documents in
SLOTS hashed counters, summed in every task before it sends anything; equal counts go by hash. The order decides how much work
there is, never what is found: two similar sets share one of the first n - t + 1 shingles of each, t being the least
intersection for their sizes, in any order (Chaudhuri et al. 2006; Xiao et al. 2008).

Classes are joined on the shingles of their prefixes and on steps of sizes (length filter). A pair is kept if its sizes fit, if what
follows its first common place can still give t (positional), and if the suffixes behind that place can (suffix): PIVOTS cut the order into
pieces, and the sums over pieces of the differences of how many shingles both suffixes have there are bounds of how much
they differ; of whole sets the same bound stands in the join's condition. What is left is verified once a pair on whole sets.

The result are classes of linked documents, so no pair inside of a component is needed. In the list of a prefix shingle,
members are first compared with one of them, that which shares most with others; such rounds go on with further
members while lists hold more pairs than PATIENCE times their rows and rounds still find links. What the links don't join is compared pair by pair
between components: members outside of a list's largest component with all others. So every pair of similar sets in
different components is verified, whatever a list holds.

Defined results: a null or empty text has the empty set, n_shingles 0, and is linked with nothing; a text of fewer words than a
shingle is one shingle; rows that repeat a doc_id are one document: whatever their texts, they are linked with each other, but for those
without words; a row of null doc_id keeps its n_shingles and has a null component_id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph, minhash

SHINGLE = 3
#: The least similarity as a fraction of integers, so that it is exact.
PART, WHOLE = 90, 100
#: Counters of shingles, in chunks that are summed as one row; pieces of the order for the suffix filter.
SLOTS, CHUNK, PIECES = 1 << 20, 1 << 15, 32
#: Digests of texts that a task remembers, so that repeated texts are counted and sent once by it.
REMEMBER = 100_000
#: Rounds of comparing with one member, and pairs for each row of the lists beyond which another round is tried.
ROUNDS, PATIENCE = 4, 4

HASH_BITS = 44
SKETCH = "doc_id long, n long, hi long, lo long, chunk int, counts binary"


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[np.ndarray], list[tuple[int, int]]]]:
    words = minhash.Words()
    for ids, texts in minhash._portions(batches):
        sets = minhash.shingle_sets(texts, words, size)
        yield ids, sets, list(map(minhash._digest, sets))


class Seen(set):
    """Digests met so far; forgets everything when it is full."""

    def new(self, digest: tuple[int, int]) -> bool:
        if digest in self:
            return False
        if len(self) >= REMEMBER:
            self.clear()
        self.add(digest)
        return True


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, hi, lo) of every document, the size and 128-bit hash of its set; and rows of a chunk with its counters, one a task and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = Seen(), np.zeros(SLOTS, np.int64)
        for ids, sets, digests in _sets(batches, size):
            new = [s for s, d in zip(sets, digests, strict=True) if len(s) and seen.new(d)]
            if new:
                counts += np.bincount(slot(np.concatenate(new)), minlength=SLOTS)
            hi, lo = (pa.array([d[i] for d in digests], pa.int64()) for i in range(2))
            none = [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, sets)), pa.int64()), hi, lo, *none], ["doc_id", "n", "hi", "lo", "chunk", "counts"])
        parts = counts.reshape(-1, CHUNK)
        some = np.flatnonzero(parts.any(1))
        packed = pa.array([_packed(parts[i]) for i in some], pa.binary())
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), pa.int64())] * 4, pa.array(some, pa.int32()), packed], ["doc_id", "n", "hi", "lo", "chunk", "counts"])

    return _source(docs).mapInArrow(run, SKETCH)


def slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counters of a chunk in as few bytes as its largest needs, or those that aren't 0 with their places if these take less."""
    some, most = np.flatnonzero(counts), int(counts.max())
    width = next(n for n in (1, 2, 4, 8) if most < 1 << 8 * n)
    if len(some) * (2 + width) < CHUNK * width // 2:
        return some.astype("<u2").tobytes() + counts[some].astype(f"<u{width}").tobytes() + bytes([width])
    return counts.astype(f"<u{width}").tobytes()


def _counters(chunk: bytes) -> np.ndarray:
    if len(chunk) % CHUNK == 0:
        return np.frombuffer(chunk, f"<u{len(chunk) // CHUNK}").astype(np.int64)
    n, out = (len(chunk) - 1) // (2 + chunk[-1]), np.zeros(CHUNK, np.int64)
    out[np.frombuffer(chunk, "<u2", n)] = np.frombuffer(chunk, f"<u{chunk[-1]}", n, 2 * n)
    return out


def rarity(sketched: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur, from the sums of what tasks counted: SLOTS numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[chunk] = total.get(chunk, 0) + _counters(counts.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(v) for v in total.values()], pa.binary())], ["chunk", "counts"])

    rows = sketched.filter(F.col("chunk").isNotNull()).select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros((SLOTS // CHUNK, CHUNK), np.int64)
    for r in rows.toLocalIterator():  # a row a chunk
        out[r["chunk"]] += _counters(bytes(r["counts"]))
    return out.ravel()


class Order:
    """The global order: a shingle's place is its rank by rarity, then its hash. pivots cut it in pieces that hold about as many shingles of all texts."""

    def __init__(self, counts: np.ndarray):
        self.ranks = np.minimum(np.floor(np.log2(1.0 + counts) * 1024), (1 << 19) - 1).astype(np.uint32)
        held = np.bincount(self.ranks, weights=counts)
        ends = np.cumsum(held)
        wanted = ends[-1] * np.arange(1, PIECES) / PIECES
        rank = np.searchsorted(ends, wanted, "left").clip(0, len(ends) - 1)
        share = np.clip((wanted - (ends - held)[rank]) / np.maximum(held[rank], 1), 0, 1)
        self.pivots = (rank.astype(np.uint64) << np.uint64(HASH_BITS)) + (share * ((1 << HASH_BITS) - 1)).astype(np.uint64)

    def places(self, shingles: np.ndarray) -> np.ndarray:
        """Sorted places of a set's shingles."""
        rank = self.ranks[slot(shingles)].astype(np.uint64)
        return np.sort((rank << np.uint64(HASH_BITS)) | (shingles & np.uint64((1 << HASH_BITS) - 1)))


def prefix_size(n: int, part: int = PART, whole: int = WHOLE) -> int:
    """How many first shingles of a set of n a similar set must meet, whatever its size: n - t + 1 for the smallest t, n * part / whole."""
    return n - -(-n * part // whole) + 1


def prefixes(docs: DataFrame, order: Order, size: int = SHINGLE, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """(hi, lo, n, prefix, ends, held): of every set, once a task, the places of its prefix, how many of its shingles lie before each pivot, and how many in each piece, a byte each, 255 at most."""
    sent = docs.sparkSession.sparkContext.broadcast(order)  # SLOTS ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for _, sets, digests in _sets(batches, size):
            new = [(d, s) for d, s in zip(digests, sets, strict=True) if len(s) and seen.new(d)]
            if not new:
                continue
            placed = [sent.value.places(s) for _, s in new]
            first = [p[: prefix_size(len(p), part, whole)].astype(np.int64) for p in placed]
            ends = [np.searchsorted(p, sent.value.pivots).astype(np.int32) for p in placed]
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(list(map(len, x)))], pa.int32()), pa.array(np.concatenate(x), kind))
            hi, lo = (pa.array([d[i] for d, _ in new], pa.int64()) for i in range(2))
            held = [np.minimum(np.diff(np.r_[0, e, len(p)]), 255).astype(np.uint8).view(np.int64) for e, p in zip(ends, placed, strict=True)]
            arrays = [hi, lo, pa.array(list(map(len, placed)), pa.int64()), lists(first, pa.int64()), lists(ends, pa.int32()), lists(held, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["hi", "lo", "n", "prefix", "ends", "held"])

    return _source(docs).mapInArrow(run, "hi long, lo long, n long, prefix array<long>, ends array<int>, held array<long>")


def least_common(n: Column, m: Column, part: int = PART, whole: int = WHOLE) -> Column:
    """The least intersection of similar sets of n and m shingles."""
    return F.ceil((n + m) * part / F.lit(float(part + whole)) - 1e-9)


def fits(n: Column, i: Column, m: Column, j: Column, upto: Column, part: int = PART, whole: int = WHOLE) -> Column:
    """Length and positional filter: whether sets of n and m that have their i-th and j-th shingle in common can be similar. upto: how many up to that place they can have in common, 1 if it is the first."""
    lengths = F.least(n, m) * whole >= F.greatest(n, m) * part
    return lengths & (upto + F.least(n - i, m - j) >= least_common(n, m, part, whole))


def suffixes_fit(n: Column, i: Column, a: Column, m: Column, j: Column, b: Column, upto: Column, part: int = PART, whole: int = WHOLE) -> Column:
    """Suffix filter: a and b say how many shingles lie before each pivot. In every piece the suffixes behind i and j differ by as much as their numbers there."""
    behind = lambda ends, at, size: F.transform(F.concat(ends, F.array(size.cast("int"))), lambda e: F.greatest(e, at.cast("int")))
    gaps = F.zip_with(behind(a, i, n), behind(b, j, m), lambda x, y: x - y)
    before = F.slice(F.concat(F.array((i - j).cast("int")), gaps), F.lit(1), F.size(gaps))
    differ = F.aggregate(F.zip_with(gaps, before, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return upto + (n - i + m - j - differ) / 2 >= least_common(n, m, part, whole)


def pieces_fit(n: Column, a: list[Column], m: Column, b: list[Column], part: int = PART, whole: int = WHOLE) -> Column:
    """The same bound for whole sets, from their packed numbers by piece, cheap enough for the condition of a join."""
    byte = lambda x, i: F.shiftrightunsigned(x, 8 * i).bitwiseAND(255)
    differ = sum((F.abs(byte(x, i) - byte(y, i)) for x, y in zip(a, b, strict=True) for i in range(8)), F.lit(0))
    return n + m - differ >= 2 * least_common(n, m, part, whole)


def classes_of(sketched: DataFrame, prefixed: DataFrame) -> DataFrame:
    """(node, hi, lo, rep, copies, n, prefix, ends, held) of each class of equal sets: its number, its smallest id, its documents. Materialised, for numbers hold for one computation."""
    reps = sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    first = prefixed.groupBy("hi", "lo").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "ends", "held")])
    return common.stored(reps.join(first, ["hi", "lo"]).withColumn("node", F.monotonically_increasing_id()))


def lists(classes: DataFrame, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """(s, node, n, i, met), stored: members of the lists of prefix shingles that several classes share; i is the shingle's place in the set, from 1.

    A list holds one shingle and sizes that may fit: a class is in the lists of its own step of sizes and of the next one, and similar sets
    are a step apart at most. met: in how many places of lists a class is.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(whole / part) * (1 + 1e-6)))
    each = classes.select("node", "n", F.posexplode("prefix").alias("i", "place"), step.alias("step")).withColumn("step", F.explode(F.array("step", F.col("step") + 1)))
    each = each.select(F.xxhash64("place", "step").alias("s"), "node", (F.col("i") + 1).alias("i"))
    with common.Tables(classes.sparkSession) as own:
        shared = own.stored(each.groupBy("s").agg(F.count("*").alias("k")).filter("k > 1").select("s"))
        held = own.stored(each.join(shared, "s"))  # both grow with the input: a shuffle at any size
        sizes = held.groupBy("node").agg(F.count("*").alias("met")).join(classes.select("node", "n"), "node")
        return common.stored(held.join(own.stored(sizes), "node").select("s", "node", "n", F.col("i").cast("long").alias("i"), "met"))


def _first_met(pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb, i, j) once for each pair, with its first common place; a < b."""
    swap = F.col("a") > F.col("b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    put = pairs.select(*[either(x, y).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"), ("i", "j"), ("j", "i"))])
    return put.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.min("i").alias("i"), F.min("j").alias("j"))


def star_pairs(rooted: DataFrame, nth: int) -> DataFrame:
    """Pairs of each list's members with one of them, of the list's nth largest component, that may be similar and lie in different components."""
    per = rooted.groupBy("s", "root").agg(F.count("*").alias("k"), F.max(F.struct("met", "n", "node", "i")).alias("star"))
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("k"), F.desc("star.met"), "root"))
    stars = per.withColumn("r", rank).filter(F.col("r") == nth).select("s", F.col("root").alias("other"), F.col("star.node").alias("b"), F.col("star.n").alias("nb"), F.col("star.i").alias("j"))
    met = rooted.join(stars, "s").filter("root <> other").filter(fits(F.col("n"), F.col("i"), F.col("nb"), F.col("j"), F.least("i", "j")))
    return met.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb", "i", "j")


def crossing_pairs(rooted: DataFrame, pieces: DataFrame, own: common.Tables) -> DataFrame:
    """All pairs in the lists that may be similar and lie in different components: one of the two is outside of its list's largest. pieces: (node, held); own keeps what is stored meanwhile."""
    per = rooted.groupBy("s", "root").agg(F.count("*").alias("k"))
    top = per.groupBy("s").agg(F.max(F.struct("k", "root")).getField("root").alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("s", "top")
    words = range(PIECES // 8)
    placed = own.stored(rooted.join(top, "s").join(pieces, "node").select("s", "node", "n", "i", "root", "top", *[F.get("held", F.lit(x)).alias(f"p{x}") for x in words]))
    a = placed.filter("root <> top").select("s", F.col("node").alias("a"), F.col("n").alias("na"), "i", F.col("root").alias("ra"), *[F.col(f"p{x}").alias(f"a{x}") for x in words])
    b = placed.select("s", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("j"), F.col("root").alias("rb"), *[F.col(f"p{x}").alias(f"b{x}") for x in words])
    near = pieces_fit(F.col("na"), [F.col(f"a{x}") for x in words], F.col("nb"), [F.col(f"b{x}") for x in words])
    met = a.join(b, (a["s"] == b["s"]) & (F.col("ra") != F.col("rb")) & fits(F.col("na"), F.col("i"), F.col("nb"), F.col("j"), F.lit(1)) & near)
    return met.select("a", "b", "na", "nb", "i", "j")


def open_pairs(rooted: DataFrame) -> int:
    """How many pairs of the lists lie in different components, lists counted each."""
    per = rooted.groupBy("s", "root").agg(F.count("*").cast("double").alias("k"))
    by = per.groupBy("s").agg((F.pow(F.sum("k"), F.lit(2)) - F.sum(F.col("k") * F.col("k"))).alias("p"))
    return int((by.agg(F.sum("p")).first()[0] or 0) / 2)


def components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    sketched = common.stored(sketch(docs, size))
    order = Order(rarity(sketched))
    documents = sketched.filter(F.col("chunk").isNull()).select("doc_id", "n", "hi", "lo")
    classes = classes_of(documents, prefixes(docs, order, size))
    members = lists(classes)
    ends, rows = classes.select("node", "ends"), members.count()
    tried: DataFrame | None = None
    kept = ""
    links = common.cut(documents.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0))
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def rooted(own: common.Tables) -> DataFrame:
        return own.stored(members.join(common.small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))

    def verified(pairs: DataFrame, upto: Column, own: common.Tables) -> tuple[DataFrame, DataFrame]:
        """Pairs that were not tried before, and the links among them. Whole sets are made for what passes all filters."""
        once = _first_met(pairs)
        once = own.stored(once if tried is None else once.join(tried, ["a", "b"], "left_anti"))
        left, right = ends.select(F.col("node").alias("a"), F.col("ends").alias("ea")), ends.select(F.col("node").alias("b"), F.col("ends").alias("eb"))
        near = once.join(left, "a").join(right, "b").filter(suffixes_fit(*map(F.col, ("na", "i", "ea", "nb", "j", "eb")), upto))
        near = own.stored(near.select("a", "b"))
        nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        wanted = common.cut(classes.select("node", "rep", "hi", "lo").join(nodes, "node", "left_semi"))
        texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(common.small(wanted), "rep")
        sets = own.stored(minhash.sets_of(texts, size))
        if sets.count() > wanted.count():  # tasks saw rows that repeat a document
            sets = own.stored(sets.dropDuplicates(["node"]))
        return once.select("a", "b"), common.cut(minhash.verify(near, sets, PART, WHOLE))

    for nth in range(1, ROUNDS + 1):
        with common.Tables(docs.sparkSession) as own:  # what a round stores goes when its links are kept
            now = rooted(own)
            if nth > 1 and open_pairs(now) <= PATIENCE * rows:
                break
            pairs, found = verified(star_pairs(now, nth), F.least("i", "j"), own)
            before, (tried, kept) = kept, common.store(pairs if tried is None else tried.unionByName(pairs))
        if before:
            common.delete(docs.sparkSession, before)
        if found.isEmpty():
            break
        links = common.cut(links.unionByName(found))
        roots = graph.components(links, "a", "b", common.BROADCAST_BYTES)
    with common.Tables(docs.sparkSession) as own:
        _, found = verified(crossing_pairs(rooted(own), classes.select("node", "held"), own), F.lit(1), own)
    again = minhash.same_id(documents.withColumnRenamed("n", "n_shingles"), classes)
    new = [x for x in (None if found.isEmpty() else found, again) if x is not None]
    if new:
        roots = graph.components(reduce(DataFrame.unionByName, new, links), "a", "b", common.BROADCAST_BYTES)
    joined = classes.select("node", "hi", "lo", "rep", "copies").join(roots, "node", "left").filter("copies > 1 OR root IS NOT NULL")
    joined = common.cut(joined.select("hi", "lo", "rep", F.coalesce("root", "node").alias("root")))
    least = joined.groupBy("root").agg(F.min("rep").alias("component"))
    final = common.cut(joined.join(least, "root").select("hi", "lo", "component"))
    own = documents.join(common.small(final), ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
