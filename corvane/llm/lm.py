"""Masked pseudo-likelihood by a bidirectional window network, trained in numpy over the whole corpus.

Each word is predicted from the SIDE words on either side of it, never from itself; a text's pseudo-log-likelihood is
the sum of these conditional log-probabilities (Salazar et al. 2020). The network embeds the context words, scales each
place's embedding by its own weights, adds them up and squashes the sum; a softmax of three levels gives the probability
of the word's class, of its group in the class, then of the word in its group, so that the probabilities of all words add
up to 1.

The network's vocabulary comes from counts of all words of the corpus: the VOCABULARY - 2 most frequent ones, one id for
all others, one for what lies before and after a text. The probability of that one id is shared out among the others by
their counts, so that every word of the corpus has a probability of its own, and all of them add up to 1. Counts of the
HEAD next words go to every task; rarer words are joined with their counts, in a shuffle that follows the input.

Training is data-parallel and sees every window once. Texts are dealt into buckets by a hash of the document; a bucket is
one sequence of steps, in the order of the texts' hashes, and how many there are follows from the corpus's words: results
don't depend on how the input is partitioned. There are ROUNDS rounds, each over its share of the texts: all buckets start
from the same parameters, which are averaged after it, an embedding by how often each bucket met its word, the rest by
windows. What is gathered (word counts, parameters of every bucket) follows the input, what comes to the driver
(vocabulary, head, network) is bounded.

Defined results: a null or empty text has no tokens, log-probability 0 and a null mean; rows that repeat a document get
equal scores; null ids pass; an empty table gives an empty table; an input column that bears the name of an added one is
replaced; a word that the counts lack is scored as one counted once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import portions, words

CLASSES, GROUPS, MEMBERS = 32, 32, 16
VOCABULARY, SIDE, HIDDEN = CLASSES * GROUPS * MEMBERS, 2, 16
OTHER, EDGE = VOCABULARY - 2, VOCABULARY - 1
#: Windows of a training step and of a scoring block, words taken from texts at once; distinct words that a task counts before it hands them on.
BATCH, BLOCK, AT_ONCE, PARTIAL = 4096, 4096, 1 << 18, 150_000
#: Rounds of training; words of a bucket at most and at least, and buckets that a corpus between them has.
ROUNDS, BUCKET_WORDS, LEAST_WORDS, BUCKETS = 4, 2_000_000, 1 << 16, 8
#: Most words outside of the network's vocabulary whose counts every task holds.
HEAD = 200_000
#: Parameters of a row on their way to the average: whole rows of embeddings.
ROW = 256 * HIDDEN
RATE, SPARSE_RATE = 0.01, 0.2
SEED = 5


class WindowNetwork:
    """Parameters by name: embeddings, weights of places and a bias make the hidden layer; each level of the softmax has weights, biases, and vectors of what was chosen above."""

    SHAPES = {
        "emb": (VOCABULARY, HIDDEN), "place": (2 * SIDE, HIDDEN), "b": (HIDDEN,), "top": (HIDDEN, CLASSES), "tb": (CLASSES,), "kin": (CLASSES, HIDDEN), "mid": (HIDDEN, GROUPS),
        "mb": (CLASSES, GROUPS), "sub": (CLASSES * GROUPS, HIDDEN), "low": (HIDDEN, MEMBERS), "lb": (CLASSES * GROUPS, MEMBERS),
    }

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, counts: np.ndarray) -> WindowNetwork:
        """Random weights; biases that give each word its share of the corpus."""
        rng = np.random.default_rng(SEED)
        p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in cls.SHAPES.items()}
        p["place"] += 1
        share = ((counts + 1) / (counts + 1).sum()).reshape(CLASSES, GROUPS, MEMBERS)
        groups, classes = share.sum(2), share.sum((1, 2))
        p["b"] = np.zeros(HIDDEN, np.float32)
        p["tb"], p["mb"] = np.log(classes).astype(np.float32), np.log(groups / classes[:, None]).astype(np.float32)
        p["lb"] = np.log(share / groups[:, :, None]).reshape(-1, MEMBERS).astype(np.float32)
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> WindowNetwork:
        p, at = {}, 0
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(p)

    def forward(self, context: np.ndarray, word: np.ndarray) -> tuple:
        """Log-probability of each word in its context (2 SIDE ids), and what the way back needs.

        Logits stand in columns, a word each: sums and maxima then run along memory.
        """
        p = self.p
        h = np.tile(p["b"], (len(word), 1))
        for j in range(2 * SIDE):
            h += np.take(p["emb"], context[:, j], axis=0) * p["place"][j]
        np.tanh(h, out=h)
        group, member = word // MEMBERS, word % MEMBERS
        kin, own = group // GROUPS, group % GROUPS
        g = h + np.take(p["kin"], kin, axis=0)
        f = g + np.take(p["sub"], group, axis=0)
        a = p["top"].T @ h.T + p["tb"][:, None]
        c = p["mid"].T @ g.T + np.take(p["mb"].T, kin, axis=1)
        e = p["low"].T @ f.T + np.take(p["lb"].T, group, axis=1)
        columns = np.arange(len(word))
        out = np.zeros(len(word), h.dtype)
        for logits, at in ((a, kin), (c, own), (e, member)):
            logits -= logits.max(0)
            chosen = logits[at, columns]
            np.exp(logits, out=logits)
            total = logits.sum(0)
            out += chosen - np.log(total)
            logits /= total
        return out, h, g, f, kin, own, group, member, a, c, e

    def gradients(self, context: np.ndarray, word: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean negative log-probability: of all parameters but the embeddings; ids of the embeddings met; the gradients of those."""
        p, n = self.p, len(word)
        _, h, g, f, kin, own, group, member, da, dc, de = self.forward(context, word)
        columns = np.arange(n)
        for d, at in ((da, kin), (dc, own), (de, member)):
            d[at, columns] -= 1
            d /= n
        out = {"top": (da @ h).T, "tb": da.sum(1), "mid": (dc @ g).T, "low": (de @ f).T}
        df = de.T @ p["low"].T
        dg = dc.T @ p["mid"].T + df
        by = lambda rows, at, size: np.stack([np.bincount(at, x, size) for x in rows], axis=1).astype(h.dtype)  # sums of columns by at
        out["kin"], out["mb"] = by(np.ascontiguousarray(dg.T), kin, CLASSES), by(dc, kin, CLASSES)
        out["sub"], out["lb"] = by(np.ascontiguousarray(df.T), group, CLASSES * GROUPS), by(de, group, CLASSES * GROUPS)
        dh = (da.T @ p["top"].T + dg) * (1 - h * h)
        out["b"], out["place"] = dh.sum(0), np.zeros_like(p["place"])
        pulls = np.empty((2 * SIDE, n, HIDDEN), h.dtype)
        for j in range(2 * SIDE):
            out["place"][j] = np.einsum("nd,nd->d", dh, np.take(p["emb"], context[:, j], axis=0))
            pulls[j] = dh * p["place"][j]
        ids = context.T.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return out, ids[cuts], np.add.reduceat(pulls.reshape(-1, HIDDEN)[order], cuts, axis=0)


class Trainer:
    """Adam over steps of BATCH windows; embeddings, of which a step meets few, by their summed squares."""

    def __init__(self, network: WindowNetwork):
        self.net, self.steps, self.seen = network, 0, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items() if k != "emb"}
        self.squares, self.met = np.zeros_like(network.p["emb"]), np.zeros(VOCABULARY)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, context: np.ndarray, word: np.ndarray, last: bool = False) -> None:
        """Steps over whole batches of what was added so far; over all of it if it is the last."""
        self.rest.append((context, word))
        if not last and sum(len(w) for _, w in self.rest) < BATCH:
            return
        context, word = (np.concatenate(x) for x in zip(*self.rest, strict=True))
        whole = len(word) if last else len(word) // BATCH * BATCH
        for a in range(0, whole, BATCH):
            self.step(context[a : min(whole, a + BATCH)], word[a : min(whole, a + BATCH)])
        self.rest = [(context[whole:], word[whole:])]

    def step(self, context: np.ndarray, word: np.ndarray) -> None:
        self.steps += 1
        self.seen += len(word)
        rate = RATE / (1 + self.steps / 200) ** 0.5
        grads, ids, pulls = self.net.gradients(context, word)
        for k, g in grads.items():
            m, v = self.moments[k]
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            self.net.p[k] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.98**self.steps)) + 1e-8)
        self.squares[ids] += pulls * pulls
        self.net.p["emb"][ids] -= SPARSE_RATE * pulls / (np.sqrt(self.squares[ids]) + 1e-8)
        self.met += np.bincount(context.ravel(), minlength=VOCABULARY)

    def rows(self) -> Iterator[tuple[bytes, bytes]]:
        """(parameters, weights) of ROW numbers each: of embeddings a weight for each, of the others one."""
        flat, n = self.net.flat(), VOCABULARY * HIDDEN
        for a in range(0, len(flat), ROW):
            weights = self.met[a // HIDDEN : a // HIDDEN + ROW // HIDDEN] if a < n else np.array([self.seen])
            yield flat[a : a + ROW].tobytes(), weights.astype(np.float64).tobytes()


def windows(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, words) of texts that follow each other in flat; EDGE stands outside of a text."""
    n, gap = len(flat), SIDE
    at = np.arange(n) + np.repeat(np.arange(1, len(sizes) + 1) * gap, sizes)
    wide = np.full(n + gap * (len(sizes) + 1), EDGE, np.int32)
    wide[at] = flat
    return np.stack([wide[at + j] for j in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1), flat


@dataclass
class Vocabulary:
    ids: dict[bytes, int]  # of the most frequent words
    counts: np.ndarray  # of all ids
    counted: DataFrame  # (word, n) of every word of the corpus
    head: dict[bytes, int]  # counts of the most frequent of the other words

    @property
    def others(self) -> float:
        return max(float(self.counts[OTHER]), 1.0)


class Places(dict):
    """Word to its place among known words, whose number stands for any other word."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """From counts of every word of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for _, part in portions(batch.column(0)):
                seen.update(chain.from_iterable(map(words, part)))
                if len(seen) >= PARTIAL:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = docs.select(common.text_bytes().alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = common.cut(counted)
    total, texts = counted.agg(F.sum("n")).first()[0] or 0, docs.count()
    top = counted.orderBy(F.desc("n"), "word").limit(VOCABULARY - 2).collect()
    counts = np.zeros(VOCABULARY)
    counts[: len(top)] = [r["n"] for r in top]
    counts[OTHER], counts[EDGE] = total - counts.sum(), texts
    ids = {bytes(r["word"]): i for i, r in enumerate(top)}
    # the least count that no more than HEAD words reach; different counts are few, for they add up to the corpus
    least, held = None, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        held += r["words"]
        if held > HEAD + len(ids):
            break
        least = r["n"]
    head = {}
    if total > counts[: len(top)].sum() and least is not None:
        found = counted.filter(F.col("n") >= least).toArrow()
        head = {w: n for w, n in zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True) if w not in ids}
    return Vocabulary(ids, counts, counted, head)


def encoded(docs: DataFrame, vocab: Vocabulary, buckets: int = 1) -> DataFrame:
    """(bucket, mark, ids, share, rare) of each text: a hash of the document, one of the text, ids of its words, the log-shares of words of the head, words beyond it."""
    n_ids = len(vocab.ids)
    places = vocab.ids | {w: n_ids + i for i, w in enumerate(vocab.head)}
    # the network pays the words of its vocabulary in full; what a word beyond the head pays is joined later
    shares = np.concatenate([np.zeros(n_ids), np.log(np.fromiter(vocab.head.values(), float, len(vocab.head)) / vocab.others), [0.0]])
    sent = docs.sparkSession.sparkContext.broadcast((places, shares))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, share = sent.value
        place = Places(known).__getitem__
        for batch in batches:
            for start, part in portions(batch.column(2)):
                split = [words(t) for t in part]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                flat = list(chain.from_iterable(split))
                at = np.fromiter(map(place, flat), np.int32, len(flat))
                cuts = np.r_[0, np.cumsum(sizes)]
                sums = np.r_[0, np.cumsum(share[at])][cuts]
                rare = np.flatnonzero(at == len(known))
                ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.where(at < n_ids, at, OTHER).astype(np.int16), pa.int16()))
                beyond = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, cuts), pa.int32()), pa.array([flat[i] for i in rare], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, len(part)) for i in range(2)), ids, pa.array(np.diff(sums)), beyond], ["bucket", "mark", "ids", "share", "rare"])

    text = common.text_bytes()
    # of another seed than the hash of shuffles
    bucket = F.pmod(F.xxhash64(F.lit(1), "doc_id", text), F.lit(buckets)).cast("int")
    rows = docs.select(bucket.alias("bucket"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(encode, "bucket int, mark long, ids array<smallint>, share double, rare array<binary>")


def _texts(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the number of words of each text."""
    return ids.flatten().to_numpy().astype(np.int32), ids.value_lengths().to_numpy().astype(np.int64)


def train(docs: DataFrame) -> tuple[Vocabulary, WindowNetwork]:
    return _train(docs)[:2]


def _train(docs: DataFrame) -> tuple[Vocabulary, WindowNetwork, DataFrame]:
    """The vocabulary, the network, and what encoded() makes of docs, each bucket's texts together and in one order; materialised."""
    vocab = vocabulary(docs)
    spark, words_ = docs.sparkSession, vocab.counts[:EDGE].sum()
    buckets = max(1, math.ceil(words_ / min(BUCKET_WORDS, max(LEAST_WORDS, words_ / BUCKETS))))
    texts = common.cut(encoded(docs, vocab, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", "mark"))
    network = WindowNetwork.start(vocab.counts)
    for turn in range(ROUNDS):
        network = _round(texts.filter(F.pmod(F.xxhash64("mark"), F.lit(ROUNDS)) == turn), network, spark)
    return vocab, network, texts


def _round(texts: DataFrame, network: WindowNetwork, spark) -> WindowNetwork:
    """The average of what each bucket's windows make of the network."""
    before = network.flat()
    sent = spark.sparkContext.broadcast(before)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trainer = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if trainer is not None:
                trainer.add(np.zeros((0, 2 * SIDE), np.int32), np.zeros(0, np.int32), last=True)
                rows = list(trainer.rows())
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([now] * len(rows), pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], ["row", "bucket", "v", "w"])

        for batch in batches:
            own, (flat, sizes) = batch.column(0).to_numpy(), _texts(batch.column(1))
            ends = np.cumsum(sizes)
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + AT_ONCE, side="right")))
                b = min(b, a + int(np.searchsorted(own[a:], own[a], side="right")))
                if own[a] != now:
                    yield from done()
                    now, trainer = int(own[a]), Trainer(WindowNetwork.of(sent.value.copy()))
                trainer.add(*windows(flat[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b]))
                a = b
        yield from done()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so that one sum is held at a time."""
        now, total, weight = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                start = sent.value[now * ROW : now * ROW + len(total)]
                spread = np.repeat(weight, len(total) // len(weight))
                out = np.where(spread > 0, total / np.maximum(spread, 1e-9), start).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["row", "v"])

        for batch in batches:
            for row, v, w in zip(*(batch.column(c).to_pylist() for c in ("row", "v", "w")), strict=True):
                w = np.frombuffer(w, np.float64)
                v = np.frombuffer(v, np.float32).astype(np.float64) * np.repeat(w, len(v) // 4 // len(w))
                if row != now:
                    yield from done()
                    now, total, weight = row, v, w
                else:
                    total, weight = total + v, weight + w
        yield from done()

    fitted = texts.select("bucket", "ids").mapInArrow(fit, "row int, bucket int, v binary, w binary")
    together = fitted.repartition("row").sortWithinPartitions("row", "bucket")
    after = before.copy()
    for r in together.mapInArrow(mean, "row int, v binary").collect():  # the network once
        after[r["row"] * ROW : r["row"] * ROW + len(r["v"]) // 4] = np.frombuffer(r["v"], np.float32)
    return WindowNetwork.of(after)


def score(docs: DataFrame, vocab: Vocabulary, network: WindowNetwork, texts: DataFrame | None = None) -> DataFrame:
    """docs with n_words, log_prob (sum over the whole text) and mean_log_prob. texts: what encoded() makes of docs, if it is there."""
    base = common.drop_present(docs, "n_words", "log_prob", "mean_log_prob")
    mark = F.xxhash64(common.text_bytes())
    texts = encoded(base, vocab) if texts is None else texts
    sent = docs.sparkSession.sparkContext.broadcast(network.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = WindowNetwork.of(sent.value)
        for batch in batches:
            flat, sizes = _texts(batch.column(1))
            ends = np.cumsum(sizes)
            logs, a = batch.column(2).to_numpy().copy(), 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + AT_ONCE, side="right")))
                context, word = windows(flat[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b])
                each = np.zeros(len(word) + 1)
                for k in range(0, len(word), BLOCK):
                    each[k + 1 : k + 1 + BLOCK] = net.forward(context[k : k + BLOCK], word[k : k + BLOCK])[0]
                logs[a:b] += np.diff(np.cumsum(each)[np.r_[0, np.cumsum(sizes[a:b])]])
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(logs), batch.column(3)], ["mark", "n_words", "held", "rare"])

    scored = texts.select("mark", "ids", "share", "rare").mapInArrow(run, "mark long, n_words long, held double, rare array<binary>")
    scored = common.cut(scored).dropDuplicates(["mark"])
    rare = scored.select("mark", F.explode_outer("rare").alias("word")).filter("word IS NOT NULL")
    paid = rare.join(vocab.counted, "word", "left").groupBy("mark").agg(F.sum(F.log(F.coalesce("n", F.lit(1)) / F.lit(vocab.others))).alias("paid"))
    log_prob = F.col("held") + F.coalesce("paid", F.lit(0.0))
    sums = scored.select("mark", "n_words", "held").join(paid, "mark", "left").select(F.col("mark").alias("__mark"), "n_words", log_prob.alias("log_prob"), F.when(F.col("n_words") > 0, log_prob / F.col("n_words")).alias("mean_log_prob"))
    sums = common.small(common.cut(sums))
    return base.withColumn("__own", mark).join(sums, F.col("__own") == F.col("__mark")).drop("__own", "__mark")


def score_corpus(docs: DataFrame) -> DataFrame:
    """Train on all of docs, then score all of docs."""
    vocab, network, texts = _train(docs)
    return score(docs, vocab, network, texts)
