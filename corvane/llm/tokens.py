"""Exact token counts by prefix dynamic programming, for byte-pair vocabularies of scored pieces.

The encoding of a text's prefix is found from encodings of shorter prefixes: it is the one whose last piece t leaves a
prefix that ends in a piece p such that p and t stay apart when they are encoded together. So a pass over a text gives
the exact token count of every prefix, and questions about truncation or budgets need no further encoding.

Pieces never cross from other characters to a word mark, so segments are encoded on their own. A text's table is kept in
two levels: the counts at the ends of its segments, and the table of each segment, computed once per task and kept while
the cache has room. The longest prefix within a budget lies in the one segment in which the budget is passed, whose table
answers it. Segments in sorted order share the work of common beginnings. Totals of very long segments need no more of
the table than its last entries, as many as a piece is long.

Defined results: a null or empty text has no tokens (its table is [0], its longest prefix 0); repeated rows each get their count; a null
doc_id passes through; an empty table gives an empty table; an extra column that bears the name of an added one is
replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
#: Separates segments on the fast way; texts that hold it take the slow way.
SEP = "\ue000"
LIMIT = 4096
#: Characters of segments whose totals a worker keeps, with SEGMENT for what else an entry takes; pairs of pieces that it remembers;
#: characters of texts that it gathers before it computes new segments; characters of a table that is held whole.
CACHE, SEGMENT, PAIRS, GATHER, WHOLE = 64 << 20, 160, 800_000, 8 << 20, 1 << 12
SEGMENTS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


class PrefixTokenizer:
    """Prefix tables of one scored byte-pair vocabulary with byte fallback, word marks before words and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix:
            raise ValueError("this vocabulary needs a normaliser or another model than byte-pair merges")
        self.rank: dict[str, float] = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.rank):
            raise ValueError("pieces cross word marks")
        # a piece that isn't its own encoding never ends a prefix
        self.whole = {p for p in self.rank if len(p) == 1 or self._merge(p) == [p]}
        self.longest = max(map(len, self.rank))
        ends: dict[str, set[int]] = {}
        for p in self.whole:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.apart: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, int] = {}
        self.held = 0
        self._last = ("", [0], [""])

    def _merge(self, s: str) -> list[str]:
        """Encoding of a short string by merging, best score first, then leftmost."""
        parts, rank = list(s), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def table(self, s: str) -> list[int]:
        """Token counts of the prefixes of a segment, from the empty one to the whole."""
        before, counts, last = self._last
        keep = 0
        for a, b in zip(before, s, strict=False):
            if a != b:
                break
            keep += 1
        counts, last = counts[: keep + 1], last[: keep + 1]
        self._extend(s, counts, last, keep + 1, len(s))
        self._last = (s, counts, last) if len(s) <= WHOLE else ("", [0], [""])
        return counts

    def _extend(self, s: str, counts: list[int], last: list[str], start: int, end: int) -> None:
        """Add the entries of prefixes of start to end characters; the lists end with that of start - 1."""
        whole, apart, ends = self.whole, self.apart, self.ends
        shift = start - len(counts)  # entries that the lists don't hold any more
        for i in range(start, end + 1):
            tail, c = s[i - 2 if i > 1 else 0 : i], s[i - 1]
            for size in ends.get(tail, ()) if i > 1 else ():
                if size <= i and (t := s[i - size : i]) in whole:
                    p = last[i - size - shift]
                    if p == "":  # nothing before
                        break
                    ok = apart.get((p, t))
                    if ok is None:
                        ok = apart[p, t] = self._merge(p + t) == [p, t]
                    if ok:
                        break
            else:
                size, t = 1, c
            last.append(t)
            counts.append(counts[i - size - shift] + (1 if size > 1 or c in whole else len(c.encode())))

    def total(self, s: str) -> int:
        """The last entry of a segment's table."""
        if len(s) <= WHOLE:
            return self.table(s)[-1]
        counts, last = [0], [""]
        for a in range(0, len(s), WHOLE):
            self._extend(s, counts, last, a + 1, min(len(s), a + WHOLE))
            counts, last = counts[-self.longest - 1 :], last[-self.longest - 1 :]
        return counts[-1]

    @staticmethod
    def segments(text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text or SEP in text:
            return SEGMENTS.findall(MARK + text.replace(" ", MARK))
        segments = (MARK + text.replace(" ", SEP + MARK).replace("\n", f"{SEP}\n{SEP}")).split(SEP)
        return segments

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of text[:n] for every n, from 0 to the text's length."""
        out, base = array("q", [0]), 0
        for k, s in enumerate(self.segments(text)):
            counts = self.table(s)
            out.extend([base + c for c in counts[2 if k == 0 else 1 :]])  # the first mark is put before the text
            base += counts[-1]
        return out.tolist()

    def ends_of(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Segments of each text and the tokens of each, new ones computed in sorted order."""
        if self.held > CACHE:
            self.cache.clear()
            self.held = 0
        if len(self.apart) > PAIRS:
            self.apart.clear()
        cache, split = self.cache, [self.segments(t) for t in texts]
        new: set[str] = set()
        for s in split:
            new.update(s)
        for s in sorted(new.difference(cache)):
            cache[s] = self.total(s)
            self.held += len(s) + SEGMENT
        for s in split:
            yield s, list(map(cache.__getitem__, s))

    def totals(self, texts: list[str]) -> list[int]:
        """The last entries of the texts' prefix tables."""
        return [sum(own) for _, own in self.ends_of(texts)]

    def totals_and_cuts(self, texts: list[str], budget: int) -> list[tuple[int, int]]:
        """The last entry of each text's table, and the characters of its longest prefix within the budget."""
        out = []
        for text, (segments, own) in zip(texts, self.ends_of(texts), strict=True):
            whole = sum(own)
            if whole <= budget:
                out.append((whole, len(text)))
                continue
            base, at = 0, 0
            for s, n in zip(segments, own, strict=True):
                if base + n > budget or base == budget:
                    break
                base, at = base + n, at + len(s)
            at -= 1  # the mark that is put before the text
            # later segments add a token each at least; in this one the last entry that fits counts
            counts = self.table(s) if base < budget else [0]
            fits = max(i for i, n in enumerate(counts) if base + n <= budget)
            out.append((whole, max(0, at + fits)))
        return out


_loaded: dict[str, PrefixTokenizer] = {}


def tokenizer(path: str) -> PrefixTokenizer:
    """The process's tokenizer for a model file, whose tables go on from task to task."""
    if path not in _loaded:
        _loaded[path] = PrefixTokenizer(path)
    return _loaded[path]


def groups(texts: list[str], size: int = GATHER) -> Iterator[list[str]]:
    """Consecutive texts whose lengths add up to about size, one text at least."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def count_tokens(docs: DataFrame, path: str, name: str = "n_tokens", column: str = "text", budget: int | None = None, chars: str = "budget_chars") -> DataFrame:
    """docs with the token count of each whole text and, with a budget, the characters of its longest prefix within it; both from its prefix table, which stays in the worker."""
    added = [name] if budget is None else [name, chars]
    base = common.drop_present(docs, *added)
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            parts = groups([x or "" for x in batch.column("__text").to_pylist()])
            if budget is None:
                own = [[n for part in parts for n in t.totals(part)]]
            else:
                own = list(zip(*(x for part in parts for x in t.totals_and_cuts(part, budget)), strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in own)], [*kept, *added])

    fields = [T.StructField(n, T.LongType()) for n in added]
    return base.withColumn("__text", F.col(column).cast("string")).mapInArrow(run, T.StructType([*base.schema.fields, *fields]))


def with_prefix_counts(docs: DataFrame, path: str, name: str = "prefix_counts", column: str = "text") -> DataFrame:
    """docs with array<int> name: the token count of text[:n] for every n from 0 on."""
    base = common.drop_present(docs, name)
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for i, text in enumerate(batch.column("__text").to_pylist()):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in kept), pa.array([t.prefix_counts(text or "")], pa.list_(pa.int32()))], [*kept, name])

    return base.withColumn("__text", F.col(column).cast("string")).mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def tokens_of_prefix(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first `chars` characters."""
    return F.get(counts, F.least(chars if isinstance(chars, Column) else F.lit(chars), F.size(counts) - 1))


def longest_prefix(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix within a token budget; counts can fall as a prefix grows."""
    return F.size(counts) - F.array_position(F.reverse(F.transform(counts, lambda n: n <= budget)), True)
