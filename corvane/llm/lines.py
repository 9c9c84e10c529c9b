"""Line deduplication through a sharded minimal perfect hash.

Every document sends the 128-bit hashes of its distinct long lines. Counted by hash, the lines that repeat in enough
documents are indexed in shards. A shard is a minimal perfect hash (cascaded bit arrays, Limasset et al. 2017) whose
rank points into three flat arrays: a 64-bit fingerprint, the document count and the largest document id. Documents
then probe the arrays; no line is joined.

While the shards are small by count they go to every executor. Beyond the bound, probes of (shard, salt) meet the shard
in a co-grouped task instead, and documents get back the hashes that they have to drop: the same result by a shuffle. The
probes of each shard are counted before they are sent, which gives it its salts.

Documents are counted by id. Rows that share an id are one document: their lines are counted apart, by distinct id, and
such rows are found from the ids alone.

Defined results: a null or empty text is one empty line, and stays null or empty; null ids are one id, the smallest; rows
that repeat an id count once; an empty table gives an empty table; columns of the input that bear the name of an output
column are replaced.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import portions

#: White space stripped from a line's ends to get its key.
STRIP = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Index entries in a shard, and bytes of an entry (fingerprint, count, largest id, bits).
SHARD_ENTRIES, ENTRY_BYTES = 1 << 16, 22
#: Distinct lines that a task counts before it hands on its partial counts.
PARTIAL = 100_000
#: Probes that one co-grouped task takes, about.
PROBES = 1 << 19
NULL_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, None if the key is shorter than min_chars code points."""
    key = line.strip(STRIP)
    if len(key) < min_chars:
        return None
    key = key.lower()  # of bytes: A-Z alone
    if not key.isascii() and sum((b & 0xC0) != 0x80 for b in key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: level after level, keys that are alone at their bit set it; a key's index is its bit's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, start = [], 0
        for bits in levels:
            self.ranks.append(start + np.cumsum(bits, dtype=np.int64) - bits)
            start += int(bits.sum())
        self.size = start

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            at = (_mix(rest, len(levels)) % np.uint64(max(1, math.ceil(gamma * len(rest))))).astype(np.int64)
            times = np.bincount(at, minlength=max(1, math.ceil(gamma * len(rest))))
            levels.append((times == 1).astype(np.uint8))
            rest = rest[times[at] != 1]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of a key that wasn't built in, any index or -1."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out


class LineShard:
    """Perfect hash with the arrays that it points into."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.mph, self.prints, self.counts, self.last = mph, prints, counts, last

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineShard:
        keys = _mix(hi, 77) ^ lo  # distinct (hi, lo) give distinct keys, but for one pair in 2^64
        _, first = np.unique(keys, return_index=True)
        keys, lo, counts, last = keys[first], lo[first], counts[first], last[first]
        at = (mph := PerfectHash.build(keys)).index(keys)
        prints, n, big = np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
        prints[at], n[at], big[at] = lo, np.minimum(counts, 0xFFFFFFFF), last
        return cls(mph, prints, n, big)

    def last_holder(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line hash: whether it is indexed, and the largest id that holds it."""
        if not len(self.prints):
            return np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        at = self.mph.index(_mix(hi, 77) ^ lo)
        known = (at >= 0) & (self.prints[at] == lo)
        return known, self.last[at]

    def dump(self) -> bytes:
        head = struct.pack("<II", len(self.prints), len(self.mph.levels)) + struct.pack(f"<{len(self.mph.levels)}I", *map(len, self.mph.levels))
        return head + b"".join(np.packbits(x).tobytes() for x in self.mph.levels) + self.prints.tobytes() + self.counts.tobytes() + self.last.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> LineShard:
        n, k = struct.unpack_from("<II", blob)
        sizes, at, levels = struct.unpack_from(f"<{k}I", blob, 8), 8 + 4 * k, []
        for size in sizes:
            took = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, took, at), count=size))
            at += took
        prints, counts = np.frombuffer(blob, np.uint64, n, at), np.frombuffer(blob, np.uint32, n, at + 8 * n)
        return cls(PerfectHash(levels), prints, counts, np.frombuffer(blob, np.int64, n, at + 12 * n))


def _long_lines(text: bytes, min_chars: int) -> set[bytes]:
    """Hashes of the distinct long lines of a text."""
    return {line_key(line, min_chars) for line in text.split(b"\n") if len(line) >= min_chars} - {None}


def _sent(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), common.text_bytes().alias("text"))


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, n, last) of each distinct long line: its hash, the documents that hold it, the largest id of those."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            hl, values = halves(list(seen)), np.array(list(seen.values()), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(hl[:, 0].view(np.int64)), pa.array(hl[:, 1].view(np.int64)), pa.array(values[:, 0]), pa.array(values[:, 1])], ["hi", "lo", "n", "last"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for key in _long_lines(text.as_py(), min_chars):
                    if (now := seen.get(key)) is None:
                        seen[key] = [1, doc_id]
                    else:
                        now[0] += 1
                        now[1] = max(now[1], doc_id)
                if len(seen) >= PARTIAL:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if keys := _long_lines(text.as_py(), min_chars):
                    hl = halves(list(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(hl[:, 0].view(np.int64)), pa.array(hl[:, 1].view(np.int64)), pa.array([doc_id] * len(keys), pa.int64())], ["hi", "lo", "last"])

    rows = _sent(docs)
    several = common.cut(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    if several.isEmpty():
        found = rows.mapInArrow(count, "hi long, lo long, n long, last long")
    else:
        apart = common.small(several)
        once = rows.join(apart, "id", "left_semi").select("id", "text").mapInArrow(each, "hi long, lo long, last long").distinct().withColumn("n", F.lit(1).cast("long"))
        found = rows.join(apart, "id", "left_anti").select("id", "text").mapInArrow(count, "hi long, lo long, n long, last long").unionByName(once)
    return found.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): the perfect hash and arrays of each shard."""

    def build(key, rows):
        import pandas as pd

        hi, lo = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
        return pd.DataFrame({"shard": [key[0]], "blob": [LineShard.build(hi, lo, rows["n"].to_numpy(np.int64), rows["last"].to_numpy(np.int64)).dump()]})

    return counts.groupBy(F.pmod("hi", F.lit(shards)).cast("int").alias("shard")).applyInPandas(build, "shard int, blob binary")


def _rewrite(texts: list[bytes], min_chars: int, holders) -> Iterator[tuple[bytes, int, int]]:
    """New text, lines before, lines dropped of each document. holders(row numbers, digests) says which of the lines go."""
    split = [t.split(b"\n") for t in texts]
    places, digests = [], []
    for i, lines in enumerate(split):
        for j, line in enumerate(lines):
            if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None:
                places.append((i, j))
                digests.append(key)
    gone: dict[int, set[int]] = {}
    if digests:
        for (i, j), go in zip(places, holders([i for i, _ in places], digests), strict=True):
            if go:
                gone.setdefault(i, set()).add(j)
    for i, lines in enumerate(split):
        if drop := gone.get(i):
            yield b"\n".join(x for j, x in enumerate(lines) if j not in drop), len(lines), len(drop)
        else:
            yield texts[i], len(lines), 0


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """docs with repeated long lines taken out of all documents but the one of largest doc_id.

    Adds n_lines, n_dropped and kept_sha256 (of the new text) and replaces text; other columns pass through.
    """
    counts = common.cut(line_counts(docs, min_chars).filter(F.col("n") >= min_docs))
    entries = counts.count()
    shards = max(1, math.ceil(entries / SHARD_ENTRIES))
    index = build_index(counts, shards)
    added = ("text", "n_lines", "n_dropped", "kept_sha256")
    base = common.drop_present(docs, *added).columns
    schema = T.StructType([docs.schema[c] for c in base] + [T.StructField("text", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def out(batch: pa.RecordBatch, rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        bare = batch.column("__null").to_pylist()
        own = [pa.array([None if null else r[0] for null, r in zip(bare, rows, strict=True)], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in base] + own, [*base, *added])

    source = docs.select(*[F.col(f"`{c}`") for c in base], F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("__id"), common.text_bytes().alias("__text"), F.col("text").isNull().alias("__null"))
    if entries * ENTRY_BYTES <= broadcast_bytes:
        sent = docs.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in index.collect()])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {shard: LineShard.load(blob) for shard, blob in sent.value}
            for batch in batches:
                for start, texts in portions(batch.column("__text")):
                    part = batch.slice(start, len(texts))
                    ids = part.column("__id").to_numpy()

                    def holders(rows: list[int], digests: list[bytes], ids: np.ndarray = ids) -> np.ndarray:
                        hl, go = halves(digests), np.zeros(len(digests), bool)
                        shard, own = hl[:, 0].view(np.int64) % shards if shards > 1 else np.zeros(len(hl), np.int64), ids[rows]
                        for s, index_ in loaded.items():
                            at = np.flatnonzero(shard == s)
                            known, last = index_.last_holder(hl[at, 0], hl[at, 1])
                            go[at] = known & (last != own[at])
                        return go

                    yield out(part, list(_rewrite(texts, min_chars, holders)))

        result = source.mapInArrow(probe, schema)
    else:
        dropped = routed_drops(docs, index, shards, min_chars)
        joined = source.join(dropped, F.col("__id") == F.col("__probe"), "left").drop("__probe")

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, texts in portions(batch.column("__text")):
                    part = batch.slice(start, len(texts))
                    go = [set(x or ()) for x in part.column("__drop").to_pylist()]
                    yield out(part, list(_rewrite(texts, min_chars, lambda rows, digests, go=go: [d in go[i] for i, d in zip(rows, digests, strict=True)])))

        result = joined.mapInArrow(apply, schema)
    return result.select(*[F.col(f"`{c}`").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in [c for c in docs.columns if c in base or c == "text"] + list(added[1:])])


def shard_salts(docs: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """(shard, salts): the tasks that the probes of each shard need, from the number of long lines that go there."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                if keys := _long_lines(text.as_py(), min_chars):
                    seen.update((halves(list(keys))[:, 0].view(np.int64) % shards).tolist())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["shard", "n"])

    counted = _sent(docs).select("text").mapInArrow(tally, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    return common.cut(counted.select("shard", F.ceil(F.col("n") / PROBES).cast("int").alias("salts")))


def routed_drops(docs: DataFrame, index: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """(__probe, __drop): by document id the line hashes to drop, found by sending probes to the shards. A shard is copied for each salt."""
    salts = F.broadcast(shard_salts(docs, shards, min_chars))  # a row for each SHARD_ENTRIES entries

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _long_lines(text.as_py(), min_chars)
                ids += [doc_id] * len(own)
                digests += own
            if ids:
                hi = halves(digests)[:, 0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hi % shards, pa.int32()), pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["shard", "doc", "digest"])

    probes = _sent(docs).mapInArrow(emit, "shard int, doc long, digest binary").join(salts, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc", "digest"), "salts").cast("int").alias("salt"), "doc", "digest")
    spread = index.join(salts, "shard").select("shard", "blob", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def meet(asked, shard):
        import pandas as pd

        if not len(asked) or not len(shard):
            return pd.DataFrame({"doc": pd.Series([], dtype="int64"), "digest": pd.Series([], dtype="object")})
        hl, ids = halves([bytes(x) for x in asked["digest"]]), asked["doc"].to_numpy(np.int64)
        known, last = LineShard.load(bytes(shard["blob"].iloc[0])).last_holder(hl[:, 0], hl[:, 1])
        return asked.loc[known & (last != ids), ["doc", "digest"]]

    hits = probes.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(meet, "doc long, digest binary")
    return hits.groupBy(F.col("doc").alias("__probe")).agg(F.collect_set("digest").alias("__drop"))
