"""Words and phrases in texts, by the places of each term that blocks of postings hold in the order of terms.

Words are the terms of the sparse encoder, so "art" isn't found in "part". A search reads the lists of its own terms only, as
these are literals that prune row groups; a text's lists meet in one row, where places are intersected after each was
moved back by its word's place in the phrase.

Defined results: a phrase or words without a term find nothing; a null text has no words; occurrences that overlap count each.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def terms_of(words: str) -> list[str]:
    return re.findall("[a-z0-9]+", words.lower())


def _lists(held: DataFrame, terms: list[str]) -> DataFrame:
    """(id, lists): places by term of the texts that hold all terms."""
    some = sorted(set(terms))
    hits = held.filter(F.col("term").isin(some)) if some else held.limit(0)
    per = hits.groupBy("id").agg(F.collect_list(F.struct("term", "at")).alias("pairs"))
    return per.filter(F.size("pairs") == len(some)).select("id", F.map_from_entries("pairs").alias("lists"))


def holding(held: DataFrame, words: str) -> DataFrame:
    """(id): texts that hold all words, anywhere; no places are read."""
    some = sorted(set(terms_of(words)))
    hits = held.filter(F.col("term").isin(some)) if some else held.limit(0)
    return hits.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(some)).select("id")


def phrases(held: DataFrame, phrase: str) -> DataFrame:
    """(id, starts): where the words of a phrase stand one after the other, in texts in which they do."""
    terms = terms_of(phrase)
    back = lambda w, i: F.transform(F.col("lists")[w], lambda x: x - i)
    moved = [back(w, i) for i, w in enumerate(terms)]
    starts = reduce(F.array_intersect, moved) if terms else F.array().cast("array<int>")
    return _lists(held, terms).select("id", starts.alias("starts")).filter(F.size("starts") > 0)


def has_words(content: Column, words: str) -> Column:
    """Whether a text without an index holds all words."""
    bag, some = text.tokens(F.coalesce(content, F.lit(""))), sorted(set(terms_of(words)))
    return F.size(F.array_except(F.array(*map(F.lit, some)), bag)) == 0 if some else F.lit(False)


def has_phrase(content: Column, phrase: str) -> Column:
    """Whether the words of a phrase stand in a text one after the other."""
    terms = terms_of(phrase)
    joined = F.concat(F.lit(" "), F.array_join(text.tokens(F.coalesce(content, F.lit(""))), " "), F.lit(" "))
    return F.contains(joined, F.lit(f" {' '.join(terms)} ")) if terms else F.lit(False)
