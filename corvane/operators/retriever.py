"""Ranked search in collections: dense, multi-vector, sparse and hybrid, with filters before every cut."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.embed import Embedder
from ..sources import positions
from ..sources.collection import Collection
from . import filters as fl

DIGITS = scoring.DIGITS
#: Names of fields that differ between collections: of documentation, of code.
DOC_ALIASES = {"class_name": "vtk_class", "vtk_class_names": "vtk_class", "type": "chunk_type"}
CODE_ALIASES = {"class_name": "vtk_class_names", "vtk_class": "vtk_class_names"}

Filters = dict[str, Any] | Column | fl.FilterBuilder | None


def aliases(points: DataFrame) -> dict[str, str]:
    """Other names of the fields of points, by what fields there are."""
    return CODE_ALIASES if "vtk_class_names" in points.columns else DOC_ALIASES


def dense(points: DataFrame, query: list[float], k: int, key: str = "id", vec: str = "vec", norm: str | None = "norm") -> DataFrame:
    """(key, score) of the k points of largest cosine. points are filtered before."""
    length = F.col(norm) if norm and norm in points.columns else None
    scored = points.select(key, F.round(scoring.cosine(F.col(vec), query, length), DIGITS).alias("score"))
    return scoring.top_k(scored, k, "score", key)


def multi_vector(vectors: DataFrame, query: list[float], k: int, key: str = "id", vec: str = "vec", norm: str | None = "norm") -> DataFrame:
    """(key, score): for each point the largest cosine among its vectors."""
    length = F.col(norm) if norm and norm in vectors.columns else None
    best = vectors.select(key, scoring.cosine(F.col(vec), query, length).alias("s")).groupBy(key).agg(F.round(F.max("s"), DIGITS).alias("score"))
    return scoring.top_k(best, k, "score", key)


def sparse(postings: DataFrame, term_stats: DataFrame, corpus: DataFrame, query: str, k: int, key: str = "id", allowed: DataFrame | None = None) -> DataFrame:
    """(key, score) of the k points of largest BM25. allowed: keys that pass a filter; statistics stay those of the whole collection.

    Only the postings of the query's terms are read: the terms are literals, which prune the index as stored by term.
    """
    import re

    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    hits = postings.filter(F.col("term").isin(terms)) if terms else postings.limit(0)
    if allowed is not None:
        hits = hits.join(allowed.select(key), key, "left_semi")
    known = F.broadcast(term_stats.filter(F.col("term").isin(terms)))  # a row for each term of the query
    both = hits.join(known, "term").crossJoin(F.broadcast(corpus))  # one row
    weight = scoring.bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))
    return scoring.top_k(both.groupBy(key).agg(F.round(F.sum(weight), DIGITS).alias("score")), k, "score", key)


def sparse_scan(points: DataFrame, query: str, k: int, key: str = "id", content: str = "content", condition: Column | None = None) -> DataFrame:
    """sparse() for texts without a stored index: one scan for the statistics, a single row, and one that scores; nothing is shuffled.

    condition: which points may be found; the statistics are of all.
    """
    import re

    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    if not terms:
        return points.select(key, F.lit(0.0).alias("score")).limit(0)
    times = lambda w: F.size("t") - F.size(F.array_remove("t", w))

    def counted(rows: DataFrame) -> DataFrame:
        bag = rows.select(key, text.tokens(F.coalesce(F.col(content), F.lit(""))).alias("t"))
        return bag.select(key, F.size("t").alias("dl"), *[times(w).alias(f"c{i}") for i, w in enumerate(terms)])

    named = range(len(terms))
    stats = counted(points).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"c{i}") > 0).alias(f"df{i}") for i in named])
    rows = counted(points if condition is None else points.filter(condition))
    weight = lambda i: F.when(F.col(f"c{i}") > 0, scoring.bm25_weight(F.col(f"c{i}"), F.col("dl"), F.col(f"df{i}"), F.col("n"), F.col("avgdl"))).otherwise(0.0)
    # a filter on the counts would be pushed down and split every text once more for each term: rows without a term score null
    total = F.when(F.greatest(*[F.col(f"c{i}") for i in named], F.lit(0)) > 0, F.round(reduce(lambda a, b: a + b, map(weight, named)), DIGITS))
    return scoring.top_k(rows.crossJoin(F.broadcast(stats)).select(key, total.alias("score")), k, "score", key)


def fuse(branches: list[DataFrame], k: int, key: str = "id") -> DataFrame:
    """(key, score) by reciprocal ranks; each branch holds its best rows only."""
    fused = scoring.rrf([scoring.ranked(b, "score", key) for b in branches], key)
    return scoring.top_k(fused.withColumn("score", F.round("score", 9)), k, "score", key)


def result(points: DataFrame, hits: DataFrame, collection: str) -> DataFrame:
    """Hits with their payload as result rows, fallbacks of fields applied. Hits are few: they go to the points."""
    rows = points.drop("vec", "norm").join(F.broadcast(hits), "id")
    return project_result(rows, collection)


def project_result(rows: DataFrame, collection: str) -> DataFrame:
    have = set(rows.columns)
    meta = {f.name for f in rows.schema["metadata"].dataType.fields} if "metadata" in have and hasattr(rows.schema["metadata"].dataType, "fields") else set()

    def pick(name: str, default: str = "") -> Column:
        options = [F.nullif(F.col(name), F.lit(""))] if name in have else []
        options += [F.col(f"metadata.{name}")] if name in meta else []
        return F.coalesce(*options, F.lit(default))

    names = []
    if "vtk_class_names" in have:
        is_list = rows.schema["vtk_class_names"].dataType.typeName() == "array"
        names.append(F.get("vtk_class_names", F.lit(0)) if is_list else F.col("vtk_class_names"))
    names += [F.col("vtk_class")] if "vtk_class" in have else []
    score = F.coalesce("visibility_score", F.lit(0.0)) if "visibility_score" in have else F.lit(0.0)
    fields = ("synopsis", "role", "action_phrase", "variable_name", "chunk_type", "example_id")
    return rows.select(
        "id", "score", F.coalesce("content", F.lit("")).alias("content"), pick("chunk_id").alias("chunk_id"), F.lit(collection).alias("collection"), F.coalesce(*names, F.lit("")).alias("class_name"),
        *[pick(f).alias(f) for f in fields], score.alias("visibility_score"), *[pick(f).alias(f) for f in ("input_datatype", "output_datatype", "module")],
    )


class Retriever:
    """Search over collections by name. Results come with columns of project_result().

    code and docs: names of the collections that the shorthands search. least_visibility: points under it are never found.
    Filters are mappings, Columns or builders; a builder's wished conditions don't filter: among the hits, those that meet
    more of them come first. block_max: sparse search skips blocks of postings; vector_index: dense search goes through a
    collection's index of vectors, where it has one; payload_index: filters by fields go through a collection's bitmaps. All
    run their first steps when they are called.
    """

    def __init__(self, collections: dict[str, Collection], embedder: Embedder, prefetch: int = 20, code: str = "code", docs: str = "docs", limit: int = 10, least_visibility: float = 0.0, hybrid: bool = True, block_max: bool = False, vector_index: bool = False, payload_index: bool = False):
        self.collections, self.embedder, self.prefetch = collections, embedder, prefetch
        self.code, self.docs, self.limit, self.least_visibility, self.hybrid = code, docs, limit, least_visibility, hybrid
        self.block_max, self.vector_index, self.payload_index = block_max, vector_index, payload_index

    def _passing(self, name: str, filters: Filters) -> tuple[Collection, DataFrame, bool]:
        c = self.collections[name]
        conditions = self._conditions(c, filters)
        if self.payload_index and isinstance(filters, dict) and filters:
            points, visible = c.filtered(filters, aliases(c.points)), self._visible(c.points)
            return c, points if visible is None else points.filter(visible), True
        return c, reduce(lambda points, x: points.filter(x), conditions, c.points), bool(conditions)

    def _conditions(self, c: Collection, filters: Filters) -> list[Column]:
        given = filters.build() if isinstance(filters, fl.FilterBuilder) else filters
        return [x for x in (fl.build_filter(c.points, given, aliases(c.points)), self._visible(c.points)) if x is not None]

    def _visible(self, points: DataFrame) -> Column | None:
        return F.col("visibility_score") >= self.least_visibility if self.least_visibility > 0 and "visibility_score" in points.columns else None

    def _branches(self, name: str, query: str, filters: Filters, k: int, modes: tuple[str, ...]) -> list[DataFrame]:
        c, points, filtered = self._passing(name, filters)
        out = []
        for mode in modes:
            if mode == "bm25" and self.block_max:
                out.append(c.block_max().search(query, k, points if filtered else None))
            elif mode == "content" and self.vector_index and "vectors" in c.about:
                out.append(c.nearest(self.embedder.one(query), k, reduce(lambda a, b: a & b, self._conditions(c, filters)) if filtered else None))
            elif mode == "queries" and self.vector_index and "late" in c.about:
                out.append(c.nearest_queries(self.embedder.one(query), k, reduce(lambda a, b: a & b, self._conditions(c, filters)) if filtered else None))
            elif mode == "bm25":
                out.append(sparse(c.postings, c.term_stats, c.corpus_stats, query, k, allowed=points if filtered else None))
            elif mode == "queries":
                vectors = c.query_vectors.join(points.select("id"), "id", "left_semi") if filtered else c.query_vectors
                out.append(multi_vector(vectors, self.embedder.one(query), k))
            else:
                out.append(dense(points, self.embedder.one(query), k))
        return out

    def _result(self, name: str, hits: DataFrame, filters: Filters) -> DataFrame:
        points = self.collections[name].points
        if not isinstance(filters, fl.FilterBuilder):
            return result(points, hits, name).orderBy(F.desc("score"), "id")
        wished = points.join(F.broadcast(hits.select("id")), "id").select("id", filters.boost().alias("boost"))
        return result(points, hits, name).join(F.broadcast(wished), "id").orderBy(F.desc("boost"), F.desc("score"), "id").drop("boost")  # as many rows as hits

    def search(self, query: str, collection: str | None = None, limit: int | None = None, filters: Filters = None, vector_name: str = "content") -> DataFrame:
        name, limit = collection or self.code, limit or self.limit
        return self._result(name, self._branches(name, query, filters, limit, ("queries" if vector_name == "queries" else "content",))[0], filters)

    def bm25_search(self, query: str, collection: str | None = None, limit: int | None = None, filters: Filters = None) -> DataFrame:
        name, limit = collection or self.code, limit or self.limit
        return self._result(name, self._branches(name, query, filters, limit, ("bm25",))[0], filters)

    def hybrid_search(self, query: str, collection: str | None = None, limit: int | None = None, filters: Filters = None, prefetch_limit: int | None = None) -> DataFrame:
        name, limit = collection or self.code, limit or self.limit
        branches = self._branches(name, query, filters, self.prefetch if prefetch_limit is None else prefetch_limit, ("content", "bm25"))
        return self._result(name, fuse(branches, limit), filters)

    def phrase_search(self, phrase: str, collection: str | None = None, limit: int | None = None, filters: Filters = None) -> DataFrame:
        """bm25_search() among the points that hold the words of the phrase one after the other; through stored places where the collection has them."""
        name, limit = collection or self.code, limit or self.limit
        c, points, filtered = self._passing(name, filters)
        if c.about.get("positional"):
            held = c.phrase(phrase).select("id")
            held = held.join(points.select("id"), "id", "left_semi") if filtered else held
        else:
            held = points.filter(positions.has_phrase(F.col("content"), phrase)).select("id")
        return self._result(name, sparse(c.postings, c.term_stats, c.corpus_stats, phrase, limit, allowed=held), filters)

    def _either(self, query: str, collection: str, limit: int | None, filters: Filters, hybrid: bool | None) -> DataFrame:
        return (self.hybrid_search if (self.hybrid if hybrid is None else hybrid) else self.search)(query, collection, limit, filters)

    def search_code(self, query: str, limit: int | None = None, filters: Filters = None, hybrid: bool | None = None) -> DataFrame:
        return self._either(query, self.code, limit, filters, hybrid)

    def search_docs(self, query: str, limit: int | None = None, filters: Filters = None, hybrid: bool | None = None) -> DataFrame:
        return self._either(query, self.docs, limit, filters, hybrid)

    def search_by_class(self, class_name: str, collection: str | None = None, limit: int | None = None) -> DataFrame:
        return self.bm25_search(class_name, collection or self.docs, limit, {"class_name": class_name})

    def search_by_role(self, query: str, role: str, collection: str | None = None, limit: int | None = None) -> DataFrame:
        return self.hybrid_search(query, collection, limit, {"role": role})

    def search_by_datatype(self, query: str, input_type: str | None = None, output_type: str | None = None, collection: str | None = None, limit: int | None = None) -> DataFrame:
        wanted = {k: v for k, v in (("input_datatype", input_type), ("output_datatype", output_type)) if v}
        return self.hybrid_search(query, collection, limit, wanted or None)

    def search_by_module(self, query: str, module: str, limit: int | None = None) -> DataFrame:
        return self.hybrid_search(query, self.docs, limit, {"module": module})

    def search_by_chunk_type(self, query: str, chunk_type: str, limit: int | None = None) -> DataFrame:
        return self.hybrid_search(query, self.docs, limit, {"chunk_type": chunk_type})


def merge_collections(results: list[DataFrame], limit: int) -> DataFrame:
    """Best rows of several result lists; on ties the earlier list, then the smaller id. Scores of different searches aren't calibrated."""
    numbered = [r.withColumn("collection_order", F.lit(i)) for i, r in enumerate(results)]
    return reduce(lambda a, b: a.unionByName(b), numbered).orderBy(F.desc("score"), "collection_order", "id").limit(limit)


def sample_per_group(rows: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """First n rows of each group, `unknown` for null; a group-limit runs before the shuffle."""
    from pyspark.sql import Window

    named = rows.withColumn(group, F.coalesce(F.col(group), F.lit("unknown")))
    return named.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= n)
