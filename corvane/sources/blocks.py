"""Blocks of postings with bounds of their impact: exact BM25 without scoring every posting.

A block holds the postings of a term in a range of SPAN ids, with its largest term frequency and smallest text length. These
bound the weight of any of its postings whatever the statistics are, as they change with the collection. A query goes in three
steps, each a plan of Spark's (after block-max pruning, Ding and Suel 2011, with ranges of ids as in Mallia et al. 2024):

1. the bounds of its terms' blocks, without their postings, give a bound for each range of ids;
2. the ranges with the largest bounds are scored in full; the k-th best score there is a threshold;
3. only blocks of ranges whose bound reaches the threshold are read and scored.

Results equal those of scoring all postings, rounded alike, ties and filters included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from . import storage

SPAN = 512
#: Words of a portion that is put together at once; what stands for a missing id there; bytes of texts that are split at once.
PORTION, NONE, BYTES = 1 << 20, -(1 << 63), 256 << 10
BLOCK = "term string, span long, max_tf long, min_dl long, size long, ids array<long>, tfs array<int>, dls array<int>"
#: Blocks as they are shuffled and stored: ids by their distance from the first, and how many words the postings stand for.
PACKED = "term string, span long, tokens long, first long, far array<short>, tfs array<int>, dls array<int>"
#: Ranges that are scored for the threshold, by k; numbers of ranges up to which they are literals of the scan.
FIRST, LITERALS = 4, 2000


def blocks(points: DataFrame, key: str = "id", span: int = SPAN, *, content: str = "content", positional: bool = False, ranges: int | None = None, by_id: bool = False, packed: bool = False) -> DataFrame:
    """(term, span, max_tf, min_dl, size, ids, tfs, dls) of texts: the last three are the postings of a block, by id; positional: also `at`, the places of each.

    Texts, not their words, are shuffled, into ranges of ids; by_id: they lie in the order of ids, so nothing is. There words come one by one, and what lies together is put
    together in portions of PORTION words, so a range of very long texts can give a term several blocks, each with other ids.
    packed: PACKED, and `at`.
    """
    texts = points.select(F.floor(F.col(key) / span).alias("span"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(content), F.lit("")).alias("t"))
    form = f"{PACKED if packed else BLOCK}{', at array<array<int>>' * positional}"
    if by_id:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for portion in _portions(_words(batches)):
                yield from _formed(portion, positional, packed)
                del portion
                pa.default_memory_pool().release_unused()  # workers live on when their tasks have ended

        return texts.select("span", "id", F.lower("t").alias("t")).mapInArrow(split, form)
    laid = texts.repartitionByRange(ranges, "span") if ranges else texts.repartitionByRange("span")
    words = laid.sortWithinPartitions("span", "id").select("span", "id", text.tokens("t").alias("w"))
    spread = words.select("span", "id", F.size("w").alias("dl"), F.posexplode("w").alias("place", "term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _portions(batches):
            yield from _formed(portion, positional, packed)

    return spread.mapInArrow(run, form)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(span, id, dl, place, term) of (span, id, text in lower case) rows: the words of text.tokens(), BYTES of texts at once."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES, "right")))
            rows = batch.slice(a, b - a)
            listed = pc.split_pattern(pc.replace_substring_regex(rows.column(2), "[^a-z0-9]+", " "), " ")
            words = listed.flatten()
            some = pc.not_equal(words, "")
            of = np.repeat(np.arange(len(rows)), pc.list_value_length(listed).to_numpy(zero_copy_only=False))[some.to_numpy(zero_copy_only=False)]
            dl = np.bincount(of, minlength=len(rows)).astype(np.int32)
            place = (np.arange(len(of)) - (np.cumsum(dl) - dl)[of]).astype(np.int32)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(dl[of]), pa.array(place), words.filter(some)], ["span", "id", "dl", "place", "term"])
            a = b


def _formed(rows: pa.Table, positional: bool, packed: bool) -> list[pa.RecordBatch]:
    if not len(rows):
        return []
    found = _grouped(rows, positional)
    if not packed:
        return found.to_batches()
    ids = found.column("ids").combine_chunks()
    whole, ends = ids.flatten(), ids.offsets.to_numpy()
    first = whole.take(pa.array(ends[:-1]))
    far = pc.subtract(whole, first.take(pa.array(np.repeat(np.arange(len(first)), np.diff(ends)))))
    tfs = found.column("tfs").combine_chunks().flatten().to_numpy()
    columns = {n: found.column(n) for n in ("term", "span")} | {"tokens": np.add.reduceat(tfs, ends[:-1], dtype=np.int64), "first": first, "far": pa.ListArray.from_arrays(ids.offsets, far.cast(pa.int16()))} | {n: found.column(n) for n in ("tfs", "dls", "at")[: 2 + positional]}
    return pa.table(columns).to_batches()


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in portions that end with a range or, if it is longer than PORTION, with an id."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) < PORTION:
            continue
        whole = pa.Table.from_batches(held)
        for name in ("span", "id"):
            column = whole.column(name).combine_chunks().fill_null(NONE).to_numpy()
            ends = np.flatnonzero(column[1:] != column[:-1]) + 1
            if len(ends):
                yield whole.slice(0, ends[-1])
                whole = whole.slice(ends[-1])
                break
        held = whole.to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _grouped(rows: pa.Table, positional: bool) -> pa.Table:
    """The blocks of (span, id, dl, place, term) rows by span and id."""
    whole = lambda name: rows.column(name).combine_chunks()
    spans, ids, dl, place = (whole(n).fill_null(NONE if n in ("span", "id") else 0).to_numpy() for n in ("span", "id", "dl", "place"))
    terms = whole("term").dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64)
    # spans ascend, so their ranks are numbers of changes
    at = np.concatenate([[0], np.cumsum(spans[1:] != spans[:-1])]) * len(terms.dictionary) + code
    order = np.argsort(at, kind="stable")
    at, ids, dl = at[order], ids[order], dl[order]
    starts = lambda *of: np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in of])]))
    one = starts(at, ids)  # a posting each
    tf, longest = np.diff(np.append(one, len(at))).astype(np.int32), np.maximum.reduceat(dl, one).astype(np.int32)
    block = starts(at[one])
    ends = pa.array(np.append(block, len(one)).astype(np.int32))
    known = lambda x: pa.array(x, pa.int64(), mask=x == NONE)
    listed = lambda x: pa.ListArray.from_arrays(ends, x)
    first = order[one[block]]
    columns = {
        "term": terms.dictionary.take(pa.array(code[first])), "span": known(spans[first]), "max_tf": pa.array(np.maximum.reduceat(tf, block).astype(np.int64)),
        "min_dl": pa.array(np.minimum.reduceat(longest, block).astype(np.int64)), "size": pa.array(np.diff(np.append(block, len(one))).astype(np.int64)), "ids": listed(known(ids[one])), "tfs": listed(pa.array(tf)), "dls": listed(pa.array(longest)),
    }
    if positional:
        places = pa.ListArray.from_arrays(pa.array(np.append(one, len(at)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
        columns["at"] = listed(places)
    return pa.table(columns)


def store(points: DataFrame, path: str, buckets: int | None = None, *, positional: bool = False, ranges: int | None = None, by_id: bool = False) -> None:
    """Blocks as Parquet in the order of terms and ranges, which prunes files and row groups by both; each() gives their postings.

    They are written once before, as ranges are sampled.
    """
    spark = points.sparkSession
    blocks(points, positional=positional, ranges=ranges, by_id=by_id, packed=True).write.option("compression", "zstd").parquet(f"{path}-by-id")
    found, parts = spark.read.parquet(f"{path}-by-id"), buckets or ranges
    laid = found.repartitionByRange(parts, "term", "span") if parts else found.repartitionByRange("term", "span")
    told = [F.array_max("tfs").cast("long").alias("max_tf"), F.array_min("dls").cast("long").alias("min_dl"), F.size("tfs").cast("long").alias("size")]
    laid = laid.sortWithinPartitions("term", "span").select("term", "span", *told, "tokens", "first", "far", "tfs", "dls", *["at"] * positional)
    laid.write.option("compression", "zstd").parquet(path)
    storage.delete(spark, f"{path}-by-id")


def each(held: DataFrame, *more: str) -> DataFrame:
    """(term, id, and more of tf, dl, at) of stored blocks; a condition on terms prunes what is read."""
    lists = {"tf": "tfs", "dl": "dls", "at": "at"}
    some = held.select("term", "first", F.explode(F.arrays_zip("far", *[lists[m] for m in more])).alias("p"))
    return some.select("term", (F.col("first") + F.col("p.far")).alias("id"), *[F.col(f"p.{lists[m]}").alias(m) for m in more])


def postings(held: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of blocks."""
    return each(held, "tf", "dl").select("term", "id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


def places(held: DataFrame) -> DataFrame:
    """(term, id, at): the places, from 0 and ascending, of every term of every text, of blocks with places."""
    return each(held, "at")


def terms_of(query: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", query.lower())))


class BlockMax:
    """Sparse search over stored blocks of one or more folders."""

    def __init__(self, parts: list[tuple[DataFrame, DataFrame | None]], term_stats: DataFrame, corpus: DataFrame):
        """parts: blocks, each with the ids in it that don't count any more, or None."""
        self.parts, self.term_stats, self.corpus = parts, term_stats, corpus

    def bounds(self, terms: list[str]) -> DataFrame:
        """(span, bound): the largest score that any id of a range can have. Postings aren't read."""
        meta = [p.filter(F.col("term").isin(terms)).select("term", "span", "max_tf", "min_dl") for p, _ in self.parts]
        whole = meta[0]
        for m in meta[1:]:
            whole = whole.unionByName(m)
        known = F.broadcast(self.term_stats.filter(F.col("term").isin(terms)))  # a row a term of the query
        both = whole.join(known, "term").crossJoin(F.broadcast(self.corpus))  # one row
        weight = scoring.bm25_weight(F.col("max_tf"), F.col("min_dl"), F.col("df"), F.col("n"), F.col("avgdl"))
        return both.withColumn("w", weight).groupBy("span", "term").agg(F.max("w").alias("w")).groupBy("span").agg(F.sum("w").alias("bound"))

    def scored(self, terms: list[str], spans: list[int] | DataFrame, allowed: DataFrame | None, key: str = "id") -> DataFrame:
        """(key, score) of the ids that hold a term in the given ranges: literals of the scan, or rows."""
        rows = None
        for held, dead in self.parts:
            some = held.filter(F.col("term").isin(terms))
            some = some.filter(F.col("span").isin(spans)) if isinstance(spans, list) else some.join(spans, "span", "left_semi")
            own = each(some, "tf", "dl").withColumnRenamed("id", key)
            own = own if dead is None else own.join(dead.withColumnRenamed("id", key), key, "left_anti")
            rows = own if rows is None else rows.unionByName(own)
        rows = rows if allowed is None else rows.join(allowed.select(key), key, "left_semi")
        known = F.broadcast(self.term_stats.filter(F.col("term").isin(terms)))  # a row a term of the query
        both = rows.join(known, "term").crossJoin(F.broadcast(self.corpus))  # one row
        weight = scoring.bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))
        return both.groupBy(key).agg(F.round(F.sum(weight), scoring.DIGITS).alias("score"))

    def threshold(self, terms: list[str], bounds: DataFrame, k: int, allowed: DataFrame | None) -> float | None:
        """A score that k ids reach, from the ranges of largest bounds; None if these hold fewer."""
        first = [r["span"] for r in bounds.orderBy(F.desc("bound"), "span").limit(FIRST * k).collect()]
        best = scoring.top_k(self.scored(terms, first, allowed), k, "score", "id").collect()
        return best[-1]["score"] if len(best) == k else None

    def plan(self, query: str, k: int, allowed: DataFrame | None = None) -> tuple[list[str], DataFrame]:
        """The terms of a query and the (span, bound) rows that can hold one of its k best."""
        terms = terms_of(query)
        bounds = self.bounds(terms)
        least = self.threshold(terms, bounds, k, allowed) if terms and k > 0 else None
        return terms, bounds if least is None else bounds.filter(F.col("bound") + 10.0**-scoring.DIGITS >= least)

    def search(self, query: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(id, score) of the k best; allowed: ids that pass a filter, the statistics stay those of the whole collection."""
        terms, left = self.plan(query, k, allowed)
        listed = [r["span"] for r in left.select("span").limit(LITERALS + 1).collect()]
        spans = listed if len(listed) <= LITERALS else left.select("span")
        return scoring.top_k(self.scored(terms, spans, allowed), k, "score", "id")
