"""Toxicity: a convolutional text classifier, trained in numpy.

Words are hashed into buckets; a bucket's embedding starts from its log-odds among the training labels (first
coordinate) and small noise. Filters of widths 1, 2 and 3 run over the words, each is max-pooled over the whole text, and
a logistic layer scores the pooled values. Everything is trained by gradient descent: through a maximum, the gradient
reaches the words that attained it. Decision thresholds are calibrated by language on all labelled rows that the fit
didn't take, from histograms of their scores; the language chooses a threshold and is never an input of the score.

The fit takes a bounded sample of labelled rows: SAMPLE_ROWS by hash of their id, and no more once they hold
SAMPLE_WORDS words. Whole texts are scored, whatever their length.

Defined results: a null or empty text is scored as one unknown word; null labels are left out; of labels that contradict
each other the larger counts; without labelled rows
every score is 0; repeated rows get equal scores; null ids and languages pass (the latter get the general threshold);
an input column that bears the name of an added one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import WordIds, crc, portions

SAMPLE_ROWS, SAMPLE_WORDS = 8_000, 16_000_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 20, 8, (1, 2, 3), 6
#: Training documents in which a bucket must occur to get an embedding; documents that halve a bucket's log-odds.
MIN_DF, SHRINK = 3, 10.0
EPOCHS, BATCH, RATE = 6, 32, 0.02
#: Labelled rows of both labels that a language's own threshold takes; bins of a histogram for one unit of log-odds.
LEAST, BINS = 5, 100
#: Words convolved at once.
BLOCK = 1 << 14


@dataclass
class TextCnn:
    buckets: np.ndarray  # sorted ids of the buckets with an embedding
    vectors: np.ndarray  # (len(buckets) + 1, DIM); the last is that of any other word, zero
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    biases: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    known: bool = True

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of vectors for bucket ids."""
        at = np.searchsorted(self.buckets, ids)
        return np.where(self.buckets[np.minimum(at, len(self.buckets) - 1)] == ids, at, len(self.buckets)) if len(self.buckets) else np.zeros(len(ids), np.int64)

    def pooled(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter over each text, and where it begins. Texts follow each other in rows; each has a word at least."""
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        best = np.full((len(sizes), len(self.biases)), -np.inf, np.float32)
        where = np.zeros((len(sizes), len(self.biases)), np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.repeat(starts + sizes, sizes)
        none, most = len(self.buckets), max(WIDTHS)
        for a in range(0, len(rows), BLOCK):
            b = min(len(rows), a + BLOCK)
            window = np.full(b - a + most - 1, none)
            reach = min(len(rows), b + most - 1)
            window[: reach - a] = rows[a:reach]
            x = self.vectors[window]
            values = []
            for width, w in zip(WIDTHS, self.filters, strict=True):
                total = x[: b - a] @ w[0]
                for j in range(1, width):
                    inside = (np.arange(a, b) + j < ends[a:b])[:, None]
                    total += np.where(inside, x[j : j + b - a] @ w[j], 0)
                values.append(total)
            z = np.concatenate(values, axis=1) + self.biases
            own = text[a:b]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            top, docs = np.maximum.reduceat(z, cuts, axis=0), own[cuts]
            better = top > best[docs]
            if self.training:
                lengths = np.diff(np.r_[cuts, b - a])
                spread = np.repeat(top, lengths, axis=0)
                at = np.minimum.reduceat(np.where(z >= spread, np.arange(a, b)[:, None], len(rows)), cuts, axis=0)
                where[docs] = np.where(better, at, where[docs])
            best[docs] = np.where(better, top, best[docs])
        return best, where

    training = False

    def score(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.zeros(len(sizes))
        best, _ = self.pooled(rows, sizes)
        return 1 / (1 + np.exp(-np.clip(np.maximum(best, 0) @ self.out + self.bias, -40, 40).astype(np.float64)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.thresholds.get(None, 0.5))


def untrained() -> TextCnn:
    return TextCnn(np.zeros(0, np.int64), np.zeros((1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0, {None: 0.5}, known=False)


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> TextCnn:
    """Train on bucket ids of whole texts but every fifth, by position, which is left to the thresholds."""
    if not len(texts):
        return untrained()
    rng = np.random.default_rng(seed)
    own = np.flatnonzero(np.arange(len(texts)) % 5 != 4)
    one = [np.unique(texts[i]) for i in own]
    ids, n = np.unique(np.concatenate(one), return_counts=True)
    buckets = ids[n >= min(MIN_DF, len(own))]
    model = untrained()
    model.known, model.buckets = True, buckets
    y = labels.astype(np.float32)
    n1, n0 = max(y[own].sum(), 0.5), max((1 - y[own]).sum(), 0.5)
    df = np.zeros((2, len(buckets) + 1))
    for i, ids in zip(own, one, strict=True):
        df[int(y[i])][model.rows(ids)] += 1
    total = df.sum(0)
    odds = (np.log((df[1] + 0.5) / (n1 + 1)) - np.log((df[0] + 0.5) / (n0 + 1))) * total / (total + SHRINK)
    model.vectors = rng.normal(0, 0.01, (len(buckets) + 1, DIM)).astype(np.float32)
    model.vectors[:, 0] += odds
    model.vectors[-1] = 0
    model.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in model.filters:  # half of the filters begin by looking for label words
        w[0, 0, : FILTERS // 2] += 1
    model.biases = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    model.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
    model.bias = float(np.log(n1 / n0))
    rows = [model.rows(t if len(t) else np.array([-1])) for t in texts]
    _train(model, rows, y, own, rng)
    return model


def _train(model: TextCnn, rows: list[np.ndarray], y: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> None:
    """Adam on filters, biases and output; plain gradient steps on the embeddings that attained a maximum."""
    params = [*model.filters, model.biases, model.out]
    bias = np.array([model.bias], np.float32)
    params.append(bias)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, model.training = 0, True
    for _ in range(EPOCHS):
        order = rng.permutation(own)
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            flat, sizes = np.concatenate([rows[i] for i in part]), np.array([len(rows[i]) for i in part])
            model.bias = float(bias[0])
            best, where = model.pooled(flat, sizes)
            ends = np.cumsum(sizes)
            act = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.bias, -40, 40)))
            err = ((p - y[part]) / len(part)).astype(np.float32)
            back = err[:, None] * model.out[None] * (best > 0)
            grads, first = [], 0
            touched, pulls = [], []
            for width, w in zip(WIDTHS, model.filters, strict=True):
                g, at, grad = back[:, first : first + FILTERS], where[:, first : first + FILTERS], np.zeros_like(w)
                for j in range(width):
                    inside = at + j < ends[:, None]
                    row = np.where(inside, flat[np.minimum(at + j, len(flat) - 1)], len(model.buckets))
                    x = model.vectors[row]  # (texts, filters, dim)
                    grad[j] = np.einsum("tf,tfd->df", g, x)
                    touched.append(row.ravel())
                    pulls.append((g[:, :, None] * w[j].T[None]).reshape(-1, DIM))
                grads.append(grad)
                first += FILTERS
            grads += [back.sum(0), act.T @ err + 1e-4 * model.out, np.array([err.sum()], np.float32)]
            step += 1
            for p_, g_, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.01 * (g_ * g_ - v)
                p_ -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            np.subtract.at(model.vectors, np.concatenate(touched), (RATE * np.concatenate(pulls)).astype(np.float32))
            model.vectors[-1] = 0
    model.bias, model.training = float(bias[0]), False


def calibrate(model: TextCnn, docs: DataFrame, rows: DataFrame) -> None:
    """For each language with enough of rows (doc_id, toxic) of both labels, the threshold of best F1; the general one elsewhere."""
    few = common.size_of(rows) <= common.BROADCAST_BYTES  # beyond it no text is shuffled: scores are
    scored = score(docs.join(F.broadcast(rows), "doc_id") if few else docs, model)
    scored = scored.drop("text", "rejected") if few else scored.drop("text", "rejected").join(rows, "doc_id")
    odds = F.log(F.col("score")) - F.log(F.greatest(1 - F.col("score"), F.lit(1e-18)))
    hit = (F.col("toxic") > 0).cast("long")
    bins = scored.groupBy("lang", F.floor(odds * BINS).alias("bin")).agg(F.sum(hit).alias("n1"), F.sum(1 - hit).alias("n0"), F.min("score").alias("low"), F.max("score").alias("high"))
    bins = common.cut(bins)
    sums = [F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.min("low").alias("low"), F.max("high").alias("high")]

    def best(own: list) -> float | None:
        n1, n0 = (np.array([r[k] for r in own], float) for k in ("n1", "n0"))
        if n1.sum() < LEAST or n0.sum() < LEAST:
            return None
        k = int(np.argmax(2 * np.cumsum(n1) / (np.cumsum(n1 + n0) + n1.sum())))
        return float((own[k]["low"] + own[k + 1]["high"]) / 2) if k + 1 < len(own) else float(own[k]["low"])

    down = lambda found: sorted(found, key=lambda r: -r["low"])
    model.thresholds = {None: best(down(bins.groupBy("bin").agg(*sums).collect())) or 0.5}
    enough = bins.groupBy("lang").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b")).filter((F.col("a") >= LEAST) & (F.col("b") >= LEAST)).select("lang")
    by: dict[str, list] = {}
    for r in bins.join(enough, "lang").collect():
        by.setdefault(r["lang"], []).append(r)
    model.thresholds |= {lang: best(down(by[lang])) for lang in sorted(by)}


def hashed(docs: DataFrame, kept: list[str], text: str = "text") -> DataFrame:
    """kept columns with array<int> ids: the buckets of each whole text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(lambda w: crc(w) % BUCKETS)
        for batch in batches:
            for start, part in portions(batch.column("__text")):
                flat, sizes = ids.ids(part)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(part)) for c in kept), lists], [*kept, "ids"])

    source = docs.select(*kept, common.text_bytes(text).alias("__text"))
    return source.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def train(docs: DataFrame, labels: DataFrame, keep: object = None) -> TextCnn:
    """Classifier from labels (doc_id, toxic) of docs (doc_id, text, lang). keep: a condition on labels' doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    rows = common.cut((rows.filter(keep) if keep is not None else rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    few = docs.join(F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)), "doc_id")
    texts, y, of, held = [], [], [], 0
    got = hashed(few, ["doc_id", "toxic"]).orderBy(F.xxhash64("doc_id"), "doc_id", F.size("ids"))
    for r in got.toLocalIterator():
        ids = np.array(r["ids"], np.int64)
        held += len(ids)
        texts.append(ids)
        y.append(int(r["toxic"] > 0))
        of.append(r["doc_id"])
        if held >= SAMPLE_WORDS:
            break
    model = fit(texts, np.array(y, np.int64))
    if not texts:
        return model
    taken = docs.sparkSession.createDataFrame([(x,) for i, x in enumerate(of) if i % 5 != 4], "doc_id long")  # SAMPLE_ROWS at most
    rest = rows.join(F.broadcast(taken), "doc_id", "left_anti")
    calibrate(model, docs, rows if len(texts) < 5 else rest)
    return model


def score(docs: DataFrame, model: TextCnn) -> DataFrame:
    """docs with score (0 to 1) and rejected (score at or over the threshold of its language)."""
    added = ("score", "rejected")
    base = common.drop_present(docs, *added)
    kept = base.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        row = dict(zip(m.buckets.tolist(), range(len(m.buckets)), strict=True))
        none = len(m.buckets)
        ids = WordIds(lambda w: row.get(crc(w) % BUCKETS, none))
        for batch in batches:
            for start, part in portions(batch.column("__text")):
                flat, sizes = ids.ids(part)
                if (empty := sizes == 0).any():
                    flat = np.insert(flat, (np.cumsum(sizes) - sizes)[empty], none)
                    sizes = np.maximum(sizes, 1)
                s = m.score(flat, sizes)
                limits = np.array([m.threshold(x) for x in batch.column("__lang").slice(start, len(part)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(part)) for c in kept), pa.array(s, pa.float64()), pa.array(m.known & (s >= limits), pa.bool_())], [*kept, *added])

    source = base.select("*", common.text_bytes().alias("__text"), lang.alias("__lang"))
    return source.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def fold(doc_id: str = "doc_id"):
    """Remainder of the id's CRC-32 by 5: fold 0 is held out of every fit."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def digest(model: TextCnn) -> str:
    return hashlib.sha256(model.vectors.tobytes() + model.out.tobytes()).hexdigest()
