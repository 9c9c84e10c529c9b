"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every GUARANTEE - K + 1 consecutive k-gram hashes of a text the smallest is kept (Schleimer et al. 2003), so two texts
that share GUARANTEE words in a row share a kept hash. Kept hashes of benchmark items are joined with those of documents;
in the documents that meet one, hits are extended word by word to all windows of items that occur there, compared as
words. An item shorter than a window is one window of its own length; for the lengths that occur (nine at most), every
gram of that length is kept, which is winnowing with a window of one.

Hashes are taken of words in lower case of all scripts, which can only add candidates; the comparison of windows
lower-cases A-Z alone.

Defined results: a null or empty text has no words and no hits; items without words or id take no part; rows that repeat
a document get equal results; a null doc_id passes through; empty tables give no hits or no rows; other columns of the
inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

GUARANTEE, K = 10, 5
#: Words of a document whose windows are made at once.
CHUNK = 8192
#: What stands between words; capitals are taken for words here and lower-cased when words are compared.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def _gram(hashes: Column, k: int):
    """Function of an element and its position: hash of the k elements from there on."""
    return lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(hashes, i + j) for j in range(1, k)])


# explode_outer() below: explode() has the optimiser infer a filter on the array's size and push it through the projections,
# where every step of a lambda would compute the arrays again.


def fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows with `words` replaced by array<long> `prints`: the kept hashes. lengths: of the short items."""
    window = GUARANTEE - K + 1
    n = F.size("h")
    hashed = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(F.lower(w)))).drop("words")
    grams = hashed.withColumn("g", F.transform("h", _gram(F.col("h"), K)))
    least = F.transform(F.slice("g", F.lit(1), F.greatest(n - GUARANTEE + 1, F.lit(0))), lambda x, i: F.least(x, *[F.get(F.col("g"), i + j) for j in range(1, window)]))
    short = [F.transform(F.slice("h", F.lit(1), F.greatest(n - m + 1, F.lit(0))), _gram(F.col("h"), m)) for m in lengths]
    return grams.withColumn("prints", F.array_distinct(F.concat(least, *short) if short else least)).drop("h", "g")


def _item_prints(items: DataFrame, lengths: list[int]) -> DataFrame:
    n = F.size("words")
    long = fingerprints(items.filter(n >= GUARANTEE), []).select(F.explode_outer("prints").alias("print"))
    short = [fingerprints(items.filter(n == m), [m]).select(F.explode_outer("prints").alias("print")) for m in lengths]
    return reduce(DataFrame.unionByName, short, long).dropna().distinct()


def _windows(words_: str, lengths: list[int]) -> Column:
    """array<struct<at, n, window>>: the windows of these lengths, as words joined by spaces."""

    def of(m: int) -> Column:
        starts = F.slice(words_, F.lit(1), F.greatest(F.size(words_) - m + 1, F.lit(0)))
        return F.transform(starts, lambda _, i: F.struct((i + 1).alias("at"), F.lit(m).alias("n"), F.array_join(F.slice(words_, i + 1, F.lit(m)), " ").alias("window")))

    return F.concat(*map(of, lengths))


def _chunks(rows: DataFrame) -> DataFrame:
    """rows with `words` in pieces of CHUNK words and as many as a window can reach on either side; lead: how many come before the piece, core: its own."""
    reach = GUARANTEE - 1
    first = F.explode_outer(F.sequence(F.lit(0), F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / CHUNK).cast("int")))
    each = rows.withColumn("chunk", first).withColumn("lead", F.least(F.col("chunk") * CHUNK, F.lit(reach)))
    each = each.withColumn("core", F.least(F.size("words") - F.col("chunk") * CHUNK, F.lit(CHUNK)))
    return each.withColumn("words", F.slice("words", F.col("chunk") * CHUNK - F.col("lead") + 1, F.col("lead") + F.lit(CHUNK + reach)))


def _key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, n_hit, items): documents in which windows of items occur, words inside of them, sorted ids of those items. mark: hash of the text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    items = common.cut(items.filter(F.col("item_id").isNotNull() & (F.size("words") > 0)))
    lengths = sorted(r[0] for r in items.filter(F.size("words") < GUARANTEE).select(F.size("words")).distinct().collect())
    prints = common.cut(_item_prints(items.select("words"), lengths))
    keyed = _key(docs)
    own = fingerprints(keyed.select("doc_id", "mark", words(F.col("text")).alias("words")), lengths)
    met = own.select("doc_id", "mark", F.explode_outer("prints").alias("print")).join(common.small(prints), "print", "left_semi")
    met = common.cut(met.select("doc_id", "mark").distinct())

    lower = items.withColumn("words", F.transform("words", lambda w: F.translate(w, common.UPPER, common.LOWER)))
    long = lower.filter(F.size("words") >= GUARANTEE).select("item_id", F.explode_outer(_windows("words", [GUARANTEE])).alias("w"))
    whole = lower.filter(F.size("words") < GUARANTEE).select("item_id", F.struct(F.lit(1).alias("at"), F.size("words").alias("n"), F.array_join("words", " ").alias("window")).alias("w"))
    known = common.cut(long.select("item_id", "w.window").unionByName(whole.select("item_id", "w.window")).dropna().groupBy("window").agg(F.collect_set("item_id").alias("items")))

    few = common.small(met)
    candidates = keyed.join(few, _same(keyed, few), "left_semi").select("doc_id", "mark", words(F.translate("text", common.UPPER, common.LOWER)).alias("words"))
    pieces = _chunks(candidates).select("doc_id", "mark", "chunk", "lead", "core", F.explode_outer(_windows("words", [GUARANTEE, *lengths])).alias("w"))
    found = pieces.select("doc_id", "mark", "chunk", "lead", "core", "w.*").join(common.small(known), "window")
    spans = found.groupBy("doc_id", "mark", "chunk", "lead", "core").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    own = F.size(F.filter(covered, lambda p: (p > F.col("lead")) & (p <= F.col("lead") + F.col("core"))))
    spans = spans.select("doc_id", "mark", own.cast("long").alias("n"), F.array_distinct(F.flatten("items")).alias("items"))
    return spans.groupBy("doc_id", "mark").agg(F.sum("n").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items) per row of docs."""
    keyed = _key(docs)
    rows = keyed.select("doc_id", "mark", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    found = common.cut(hits(docs, benchmark))
    few = common.small(found)
    return rows.join(few, _same(rows, few), "left").select(rows["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which a window of an item occurs."""
    found = common.cut(hits(docs, benchmark).select("doc_id", "mark"))
    few = common.small(found)
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(few, docs["doc_id"].eqNullSafe(few["doc_id"]) & (mark == few["mark"]), "left_anti")
