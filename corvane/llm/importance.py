"""Target-distribution importance resampling: documents are drawn by how much likelier their word runs are in a target.

Features are the runs of 1 to 3 consecutive words, repeats counted, hashed into buckets by CRC-32. External sort-count: the
buckets of a portion of texts are written as one packed stream of 16-bit numbers with the offsets of its documents; the
stored streams are sorted and run-length encoded for the counts of buckets, which are added up in each task and then over all
tasks; later the gains of the buckets are gathered along the same streams and added up by document with np.add.reduceat.
No text is read twice. A run's CRC-32 is put together from those of its words, for the CRC-32 of a concatenation is linear
in that of its first part: one table look-up a byte and a bit of the length.

A bucket's gain compares its share in the target with that in all documents, with 1 added to every bucket. The draw adds
noise by a hash of the id (Gumbel's top-k), so it is without replacement and the same on every run. Ranks come from one
sort by ranges; no task sees more than its range, and what the driver gets is one row a bucket and one a partition.

Defined results: a null text or one without words has no features and weight 0, and counts as a document of 0 words; rows that
repeat an id are documents of their own, with the same noise, and ties between them go to fewer features, then less weight;
a row of null id counts in the statistics of features but has a null score, is none of the documents to draw from and is
never drawn; an empty table gives no rows; an empty target gives every bucket the gain of an unseen one; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import TABLE, Remembered, portions

BUCKETS, RUN, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text in a stream, and of a long text that is split into words at once.
PORTION, PIECE = 1 << 19, 1 << 20


def _zero_bytes(bits: int = 32) -> np.ndarray:
    """tables[k, j, b]: what CRC-32's state has become of byte b in place j after 2**k zero bytes."""
    base = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        base = (base >> np.uint32(1)) ^ (base & np.uint32(1)) * np.uint32(0xEDB88320)
    out = np.zeros((bits, 4, 256), np.uint32)
    for j in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        out[0, j] = (state >> np.uint32(8)) ^ base[state & np.uint32(255)]
    for k in range(1, bits):
        out[k] = _moved(out[k - 1], out[k - 1])
    return out


def _moved(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    byte = lambda j: (x >> np.uint32(8 * j)) & np.uint32(255)
    return table[0][byte(0)] ^ table[1][byte(1)] ^ table[2][byte(2)] ^ table[3][byte(3)]


ZEROS = _zero_bytes()


def joined(first: np.ndarray, then: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations, from those of their two parts and the lengths of the second."""
    out = first.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero((lengths >> k) & 1)
        out[some] = _moved(ZEROS[k], out[some])
    return out ^ then


def _pieces(text: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """Words of a text in lists of a bounded size, so that a very long one isn't split at once."""
    size = size or PIECE
    text = text.translate(TABLE)
    start = 0
    while len(text) - start > size:
        end = text.rfind(b" ", start + 1, start + size)
        end = text.find(b" ", start + size) if end < 0 else end
        if end < 0:
            break
        yield text[start:end].split()
        start = end
    yield text[start:].split()


class Words(Remembered):
    """A word's CRC-32 in the lower half, its length above."""

    def __init__(self):
        super().__init__(lambda w: zlib.crc32(w) | len(w) << 32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all words of the texts in one array, and the number of words of each text."""
        parts, sizes = [], []
        for text in texts:
            own = [np.fromiter(map(self.__getitem__, w), np.uint64, len(w)) for w in _pieces(text)]
            parts.append(own)
            sizes.append(sum(map(len, own)))
        flat = list(chain.from_iterable(parts))
        return np.concatenate(flat) if flat else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def features(values: np.ndarray, sizes: np.ndarray, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of words as uint16, text after text, and each text's number of them."""
    n = len(values)
    crc, length = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the text's end
    after = joined(np.full(n, zlib.crc32(b" "), np.uint32), crc, length)
    own = np.zeros((n, run), np.uint16)
    state = crc
    own[:, 0] = state % np.uint32(buckets)
    for k in range(1, min(run, n)):
        state = joined(state[:-1], after[k:], length[k:] + 1)
        own[: n - k, k] = state % np.uint32(buckets)
    whole = left[:, None] > np.arange(run)[None]
    return own[whole], np.maximum(sizes[:, None] - np.arange(run)[None], 0).sum(1)


def streams(texts: DataFrame, doc_id: str | None = "doc_id", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(ids, words, offsets, stream): of each portion of texts the ids, numbers of words, ends in the stream, and packed buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start, part in portions(batch.column(1), PORTION):
                values, sizes = words.encode(part)
                stream, counts = features(values, sizes, buckets, run)
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (batch.column(0).slice(start, len(part)).to_pylist(), sizes.tolist(), np.cumsum(counts).tolist())]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([stream.astype("<u2").tobytes()], pa.binary())], ["ids", "words", "offsets", "stream"])

    key = F.lit(None).cast("long") if doc_id is None else F.col(doc_id).cast("long")
    return texts.select(key.alias("doc_id"), common.text_bytes().alias("text")).mapInArrow(pack, "ids array<long>, words array<long>, offsets array<long>, stream binary")


def _stream(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<u2") if value.is_valid else np.zeros(0, "<u2")


def run_lengths(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sorted array and how often each occurs."""
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], np.diff(np.r_[starts, len(ordered)])


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: streams are sorted and run-length encoded one at a time; every task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                held, times = run_lengths(np.sort(_stream(value)))
                total[held] += times
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = packed.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares in target and source, rounded down."""
    n = float(len(source))
    ratio = (target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document of the streams."""
    sent = packed.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, words, ends = (batch.column(c)[i].values for c in range(3))
                ends = ends.to_numpy()
                counts = np.diff(np.r_[0, ends])
                some, weight = np.flatnonzero(counts), np.zeros(len(ends), np.int64)
                if len(some):
                    weight[some] = np.add.reduceat(sent.value[_stream(batch.column(3)[i])], (ends - counts)[some])
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(counts, pa.int64()), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with their place from 1 in a global order, as rank: sorted by ranges, numbered in each, moved by the sizes of the ranges before."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ordered = common.cut(ordered)  # partitions and places hold for one computation
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    starts = np.r_[0, np.cumsum([n for _, n in sizes])].tolist()
    before = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "__p long, __s long")
    return ordered.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn("rank", place + F.col("__s") + 1).drop("__p", "__s", "__at")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", buckets: int = BUCKETS, run: int = RUN, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null but for the drawn, `share` hundredths of the documents of enough words."""
    packed = common.stored(streams(docs, doc_id, buckets, run))
    gain = gains(bucket_counts(packed, buckets), bucket_counts(streams(target, None, buckets, run), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = common.cut(weights(packed, gain).withColumn("score", F.col("weight") + noise))
    own = ("doc_id", "n_features", "weight", "score")
    may = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    eligible = scored.filter(may)
    most = eligible.count() * share // 100
    placed = ranked(eligible, F.desc("score"), "doc_id", "n_features", "weight")
    drawn = placed.select(*own, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.filter(~may).select(*own, F.lit(None).cast("long").alias("rank")))
