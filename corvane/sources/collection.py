"""A collection: points with payload and stored norm, query vectors, an inverted index and its statistics, as Parquet tables.

What a write adds lies in a folder of its own, and numbered manifests say which folders a version has (manifest.py). A row counts
until a later folder takes its id away, so an upsert writes only what changes: new rows, the ids that are replaced or
removed, and the signed differences of the statistics, which stay exact. compact() puts the folders together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.embed import Embedder
from ..operators import filters as fl
from . import blocks, manifest, payload, positions, segments, storage
from .late_index import LateIndex
from .vector_index import VectorIndex

PARTS = ("points", "query_vectors", "blocks", "term_stats", "corpus_stats")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with their range partition __p in a global order and their number __n in it, without one task that sorts everything."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    return parts.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))


def placed(local: DataFrame, name: str = "position") -> DataFrame:
    """Contiguous positions from 0 of stored rows from numbered(): counts by partition, one row each, give every partition its offset.

    They must be stored: ranges are sampled, so a plan that numbers rows twice, once for the counts, can number them by two sets of ranges.
    """
    counts = local.groupBy("__p").agg(F.count("*").alias("__c"))
    offsets = counts.withColumn("__o", F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    both = local.join(F.broadcast(offsets.select("__p", F.coalesce("__o", F.lit(0)).alias("__o"))), "__p")  # a row a partition
    own = [c for c in local.columns if c not in ("__p", "__n")]
    return both.select(*own, (F.col("__n") - 1 + F.col("__o")).cast("long").alias(name))


def with_positions(rows: DataFrame, *order: str) -> DataFrame:
    """Contiguous positions from 0 in a global order; rows that tie take any places among them."""
    return placed(storage.stored(numbered(rows, *order)))


def postings(points: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(term, id, tf, dl) of every term of every text."""
    bag = points.select(F.col(key).alias(key), text.tokens(F.coalesce(F.col(content), F.lit(""))).alias("t"))
    return bag.select(key, F.size("t").cast("long").alias("dl"), F.explode_outer("t").alias("term")).filter("term IS NOT NULL").groupBy("term", key).agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def text_size(content: str = "content") -> Column:
    return F.size(text.tokens(F.coalesce(F.col(content), F.lit(""))))


def corpus_stats(points: DataFrame, content: str = "content") -> DataFrame:
    return points.select(text_size(content).cast("long").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def asked_texts(rows: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(key, qpos, q): the texts of a row's `queries`, or its content where there are none."""
    text_ = F.coalesce(F.col(content), F.lit(""))
    own = F.when(F.size(F.coalesce("queries", F.array())) > 0, F.col("queries")).otherwise(F.array(text_)) if "queries" in rows.columns else F.array(text_)
    return rows.select(key, F.posexplode(own).alias("qpos", "q"))


@dataclass
class Page:
    """Rows of a scroll, the key after which the next page begins (None after the last), and how many files were read."""

    rows: list[Row]
    after: tuple | None
    files: int


@dataclass
class Collection:
    name: str
    points: DataFrame
    query_vectors: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    path: str = ""
    version: int = 0
    about: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def create(
        cls, name: str, path: str, chunks: DataFrame, embedder: Embedder | None, key: str | None = None, order: tuple[str, ...] = ("chunk_id",), content: str = "content",
        layout: tuple[str, ...] = (), buckets: int | None = None, indexed: tuple[str, ...] = (), positional: bool = False, note: dict[str, Any] | None = None,
        vectors: DataFrame | None = None,
    ) -> Collection:
        """A collection of chunks under path, in the place of what was there: the next version, which holds once all of it is written.

        Without a key column, ids are positions in the given order, ties broken by a hash of the whole row. The rows are
        stored with their ids first, and all tables come from these. Texts of `queries` have vectors too; without any, the
        content's. Without an embedder the chunks bring a column vec. layout: fields of filters; points lie in their order, so
        that statistics of files and row groups prune a filtered scan. indexed: fields with bitmaps, for filtered(). The inverted index lies in the order of terms.
        positional: places of terms are stored too, for words() and phrase(). note: what the manifest says besides, in this and later versions.
        vectors: (id, vec) of the rows, for a key and no embedder; rows without one stay.
        """
        spark, folder = chunks.sparkSession, segments.new_folder()
        before, _ = manifest.load(spark, path)
        at, staged = f"{path}/{folder}", f"{path}/{folder}/.staged"
        rows = chunks if content == "content" else chunks.withColumn("content", F.col(content))
        if key:
            segments.by_id(rows.withColumn("id", F.col(key).cast("long")), vectors).write.option("compression", "zstd").parquet(staged)
            ided = spark.read.parquet(staged)
        else:
            ties = rows.withColumn("__tie", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))
            numbered(ties, *order, "__tie").drop("__tie").write.parquet(staged)
            ided = placed(spark.read.parquet(staged), "id")
        about = {"key": key, "content": content, "layout": [f for f in layout if f in ided.columns], "buckets": buckets, "indexed": [f for f in indexed if f in ided.columns], "positional": positional} | (note or {})
        payload.check(ided.schema, about["indexed"])
        _write(at, ided, embedder, about, laid=True)
        segments.drop_staged(spark, at)
        manifest.commit(spark, path, about | {"segments": [{"folder": folder, "gone": 0}], "folders": [folder]}, before)
        manifest.vacuum(spark, path)
        return cls.read(spark, name, path)

    @classmethod
    def read(cls, spark: SparkSession, name: str, path: str, version: int | None = None) -> Collection:
        """The latest version, or one of the last two by its number."""
        number, about = manifest.load(spark, path, version)
        if not number:
            raise FileNotFoundError(f"no collection at {path}")
        parts = about["segments"]
        rows = [*(segments.alive(spark, path, parts, p) for p in PARTS[:2]), segments.alive(spark, path, parts, "blocks", blocks.postings)]
        return cls(name, *rows, segments.term_stats(spark, path, parts), segments.corpus_stats(spark, path, parts), path, number, about)

    def info(self) -> DataFrame:
        return self.points.agg(F.lit(self.name).alias("name"), F.count("*").alias("points_count"), F.lit("green").alias("status"))

    def scroll(self, columns: list[str] | None = None) -> DataFrame:
        """Payload without vectors."""
        payload = self.points.drop("vec", "norm")
        return payload.select(*columns) if columns else payload

    def upsert(self, chunks: DataFrame | None = None, embedder: Embedder | None = None, removed: DataFrame | list[int] | None = None, compact_after: int = 8, note: dict[str, Any] | None = None) -> Collection:
        """The next version: chunks take the place of rows of their ids or are added, rows of removed ids go.

        Only points of the ids concerned are read, for the terms that their old texts had. chunks have ids as at create(); of
        rows that repeat an id the last by their JSON stays, rows without an id are left out. removed: ids, or a column id;
        an id in both is replaced. Beyond compact_after folders they are put together. Another writer's version in between
        raises manifest.Conflict, and nothing changes. note: what the manifest says besides, from the moment the rows hold.
        """
        key = self.about.get("key")
        if not key:
            raise ValueError("ids of this collection are positions: create it with a key to replace rows by id")
        spark, folder = self.points.sparkSession, segments.new_folder()
        at, staged = f"{self.path}/{folder}", f"{self.path}/{folder}/.staged"
        if chunks is None:
            ided, embedder = self.points.drop("norm").limit(0), None
        else:
            rows = chunks if self.about["content"] == "content" else chunks.withColumn("content", F.col(self.about["content"]))
            rows = rows.withColumn("id", F.col(key).cast("long")).filter("id IS NOT NULL")
            rows.write.option("compression", "zstd").parquet(staged)
            ided = segments.once(spark, staged)
        ids = ided.select("id")
        if removed is not None:
            ids = ids.unionByName((spark.createDataFrame([(int(i),) for i in removed], "id long") if isinstance(removed, list) else removed.select(F.col("id").cast("long").alias("id"))))
        n_gone = segments.write_gone(ids, at)
        segments.texts_of(self.points, spark.read.parquet(f"{at}/gone"), n_gone).write.parquet(f"{staged}-old")
        _write(at, ided, embedder, self.about, spark.read.parquet(f"{staged}-old"))
        segments.drop_staged(spark, at)
        parts = [*self.about["segments"], {"folder": folder, "gone": n_gone}]
        manifest.commit(spark, self.path, self.about | {"segments": parts, "folders": [*self.about["folders"], folder]} | (note or {}), self.version)
        new = Collection.read(spark, self.name, self.path)
        return new.compact() if len(parts) > compact_after else new

    def compact(self) -> Collection:
        """The next version, with the same rows in one folder. Indexes of vectors are built anew if there were any."""
        spark, folder = self.points.sparkSession, segments.new_folder()
        at = f"{self.path}/{folder}"
        n = [segments.ranges(spark, f"{self.path}/{s['folder']}/points") for s in self.about["segments"]]
        segments.write_points(self.points, at, self.about["layout"], sum(x or 0 for x in n) or None)
        if self.about.get("indexed"):
            payload.write(spark, at, self.about["indexed"])
        self.query_vectors.write.parquet(f"{at}/query_vectors")
        segments.write_postings(spark.read.parquet(f"{at}/points"), at, self.about["buckets"], self.about.get("positional", False), parts=segments.ranges(spark, f"{at}/points"))
        segments.counts_of(self.points, text_size()).write.parquet(f"{at}/corpus_stats")
        about = {k: v for k, v in self.about.items() if k not in ("vectors", "late")} | {"segments": [{"folder": folder, "gone": 0}], "folders": [folder]}
        manifest.commit(spark, self.path, about, self.version)
        manifest.vacuum(spark, self.path)
        new = Collection.read(spark, self.name, self.path)
        new = new.index_vectors() if "vectors" in self.about else new
        return new.index_queries() if "late" in self.about else new

    def block_max(self) -> blocks.BlockMax:
        """Sparse search that skips blocks of postings."""
        spark, parts = self.points.sparkSession, self.about["segments"]
        held = [(spark.read.parquet(f"{self.path}/{s['folder']}/blocks"), segments.gone(spark, self.path, parts[i + 1 :])) for i, s in enumerate(parts)]
        return blocks.BlockMax(held, self.term_stats, self.corpus_stats)

    def index_vectors(self, lists: int | None = None) -> Collection:
        """The next version, with an index of the points' vectors. Later upserts are searched beside it until it is built anew."""
        spark, folder = self.points.sparkSession, f"part-of-vectors-{uuid.uuid4().hex}"
        VectorIndex.build(self.points, f"{self.path}/{folder}", lists=lists)
        old = self.about.get("vectors", {}).get("folder")
        folders = [f for f in self.about["folders"] if f != old]
        about = self.about | {"vectors": {"folder": folder, "segments": len(self.about["segments"])}, "folders": [*folders, folder]}
        manifest.commit(spark, self.path, about, self.version)
        return Collection.read(spark, self.name, self.path)

    def nearest(self, query: list[float], k: int, condition: Column | None = None, exact: bool = False, visits: int | None = None) -> DataFrame:
        """(id, score) of the k largest cosines through the index of vectors; condition: a filter on points, which holds before any cut."""
        spark, parts = self.points.sparkSession, self.about["segments"]
        have = self.about.get("vectors")
        if have is None:
            raise ValueError("index_vectors() first")
        index, upto = VectorIndex(spark, f"{self.path}/{have['folder']}"), have["segments"]
        later, points = parts[upto:], self.points if condition is None else self.points.filter(condition)
        replaced = segments.gone(spark, self.path, later)
        allowed = None if condition is None and replaced is None else points.select("id")
        if replaced is not None and allowed is not None:  # what the index has of replaced ids are other vectors
            allowed = allowed.join(replaced, "id", "left_anti")
        found = index.search(query, k, allowed, visits, exact)
        if not later:
            return found
        fresh = segments.alive(spark, self.path, later, "points")
        fresh = fresh if condition is None else fresh.filter(condition)
        own = fresh.select("id", F.round(scoring.cosine(F.col("vec"), query, F.col("norm")), scoring.DIGITS).alias("score"))
        return scoring.top_k(found.unionByName(own), k, "score", "id")

    def index_queries(self, lists: int | None = None) -> Collection:
        """The next version, with an index of the query vectors. Later upserts are searched beside it until it is built anew."""
        spark, folder = self.points.sparkSession, f"part-of-queries-{uuid.uuid4().hex}"
        LateIndex.build(self.query_vectors, f"{self.path}/{folder}", lists=lists)
        old = self.about.get("late", {}).get("folder")
        folders = [f for f in self.about["folders"] if f != old]
        about = self.about | {"late": {"folder": folder, "segments": len(self.about["segments"])}, "folders": [*folders, folder]}
        manifest.commit(spark, self.path, about, self.version)
        return Collection.read(spark, self.name, self.path)

    def nearest_queries(self, query: list[float], k: int, condition: Column | None = None) -> DataFrame:
        """(id, score) of the k points of which a query vector has the largest cosine, exactly, through the index of query vectors."""
        spark, have = self.points.sparkSession, self.about.get("late")
        if have is None:
            raise ValueError("index_queries() first")
        later = self.about["segments"][have["segments"] :]
        allowed = None if condition is None else self.points.filter(condition).select("id")
        replaced, among = segments.gone(spark, self.path, later), allowed
        if replaced is not None:  # what the index has of replaced ids are other vectors
            among = (self.points.select("id") if allowed is None else allowed).join(replaced, "id", "left_anti")
        found = LateIndex(spark, f"{self.path}/{have['folder']}").search(query, k, among)
        if not later:
            return found
        fresh = segments.alive(spark, self.path, later, "query_vectors")
        fresh = fresh if allowed is None else fresh.join(allowed, "id", "left_semi")
        own = fresh.select("id", scoring.cosine(F.col("vec"), query, F.col("norm")).alias("s")).groupBy("id").agg(F.round(F.max("s"), scoring.DIGITS).alias("score"))
        return scoring.top_k(found.unionByName(own), k, "score", "id")

    def filtered(self, filters: dict[str, Any] | Column | None, aliases: dict[str, str] | None = None) -> DataFrame:
        """Points that pass a filter. Bitmaps of its indexed fields are intersected first, and only files that hold some of what is left are read."""
        spark, parts = self.points.sparkSession, self.about["segments"]
        asked = payload.conditions(self.points.schema, self.about.get("indexed", []), filters, aliases or {}) if isinstance(filters, dict) else []
        if not asked:
            return fl.where(self.points, filters, aliases)
        out = []
        for i, s in enumerate(parts):
            rows, dead = payload.read(spark, f"{self.path}/{s['folder']}", asked, segments.LISTED, segments.SENT), segments.gone(spark, self.path, parts[i + 1 :])
            if rows is not None:
                out.append(rows if dead is None else rows.join(dead, "id", "left_anti"))
        if not out:
            return self.points.limit(0)
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.points.schema if f.name not in whole.columns]
        return fl.where(whole.select("*", *missing).select(*self.points.columns), filters, aliases)

    def words(self, words: str) -> DataFrame:
        """(id) of texts that hold all words, by the lists of these words alone."""
        self._positional()
        return positions.holding(self.postings.select("term", "id"), words)

    def phrase(self, phrase: str) -> DataFrame:
        """(id, starts) of texts that hold the words of a phrase one after the other, and at which words it begins."""
        self._positional()
        return positions.phrases(segments.alive(self.points.sparkSession, self.path, self.about["segments"], "blocks", blocks.places), phrase)

    def _positional(self) -> None:
        if not self.about.get("positional"):
            raise ValueError("create the collection with positional=True")

    def scroll_page(self, limit: int, after: tuple | None = None, columns: list[str] | None = None) -> Page:
        """The next rows after a key, in the order of the layout's fields and the id, reading only the files in which they lie.

        A page's `after` is the cursor for the next one. Files are chosen by their first and last keys. Rows that are added
        or taken away between two pages change what comes after the cursor and repeat nothing before it.
        """
        if limit < 1:
            raise ValueError("a page holds a row at least")
        spark, parts, order = self.points.sparkSession, self.about["segments"], [*self.about["layout"], "id"]
        key, start = F.struct(*order), None if after is None else F.struct(*[F.lit(v).cast(self.points.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)])
        plain = lambda k: tuple((v is not None, v) for v in k)  # noqa: E731  nulls come first
        wanted = [c for c in (columns or [c for c in self.points.columns if c not in ("vec", "norm")])]
        need = limit
        while True:
            reads, unread = [], []
            for i, s in enumerate(parts):
                at = f"{self.path}/{s['folder']}"
                files = spark.read.parquet(f"{at}/files")
                files = files if start is None else files.filter(F.col("last") > start)
                first = files.orderBy("first").limit(need + 1).collect()
                take, rows = [], 0
                for f in first:
                    # the first file may begin before the cursor, so its rows may not count
                    if rows < need and len(take) < need:
                        rows += f["rows"] if take or after is None else min(f["rows"], 1)
                        take.append(f["file"])
                    else:
                        unread.append(f["first"])
                        break
                if take:
                    held, dead = spark.read.parquet(*[f"{at}/points/{f}" for f in take]), segments.gone(spark, self.path, parts[i + 1 :])
                    reads.append((held if dead is None else held.join(dead, "id", "left_anti"), len(take)))
            if not reads:
                return Page([], None, 0)
            whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r for r, _ in reads])
            whole = whole if start is None else whole.filter(key > start)
            got = whole.withColumn("__key", key).orderBy(*[F.asc_nulls_first(c) for c in order]).limit(limit + 1).collect()
            bound = min((plain(k) for k in unread), default=None)
            sure = [r for r in got if bound is None or plain(r["__key"]) < bound]
            if len(sure) >= limit or bound is None:
                page = sure[:limit]
                more = bound is not None or len(sure) > limit
                last = tuple(page[-1]["__key"]) if page and more else None
                return Page([Row(**{c: r[c] for c in wanted}) for r in page], last, sum(n for _, n in reads))
            need *= 4


def _write(folder: str, ided: DataFrame, embedder: Embedder | None, about: dict[str, Any], old: DataFrame | None = None, laid: bool = False) -> None:
    """All tables of a folder for rows with ids; old: (id, content) of what they replace, whose statistics are taken off; laid: the rows lie in the order of ids."""
    spark, parts = ided.sparkSession, segments.ranges(ided.sparkSession, f"{folder}/.staged") if storage.exists(ided.sparkSession, f"{folder}/.staged") else None
    vectors = F.col("vec") if embedder is None else embedder.column(F.col("content"))
    points = ided.drop("queries").withColumn("vec", vectors).withColumn("norm", scoring.norm(F.col("vec")))
    segments.write_points(points, folder, about["layout"], parts)
    if about.get("indexed"):
        payload.write(spark, folder, about["indexed"])
    if embedder is None:
        asked = ided.select("id", F.lit(0).alias("qpos"), "vec")
    else:
        asked = asked_texts(ided).select("id", "qpos", embedder.column(F.col("q")).alias("vec"))
    asked.withColumn("norm", scoring.norm(F.col("vec"))).write.parquet(f"{folder}/query_vectors")
    segments.write_postings(ided, folder, about["buckets"], about.get("positional", False), old, parts, laid)
    # the words of all texts are those of their postings
    words = spark.read.parquet(f"{folder}/blocks").agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
    counts = ided.agg(F.count("*").alias("n")).crossJoin(words)  # a row each
    if old is not None:
        counts = counts.crossJoin(segments.counts_of(old, text_size()).toDF("m", "less"))  # a row each
        counts = counts.select((F.col("n") - F.col("m")).alias("n"), (F.col("tokens") - F.col("less")).alias("tokens"))
    counts.write.parquet(f"{folder}/corpus_stats")
