"""Token counts against the library, and word hashing."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import tokens
from corvane.llm.words import WordIds, crc, portions, words

P = pytest.importorskip("public_tokenizers")
sp = pytest.importorskip("sentencepiece")
ODD = ["", " ", "  ", "   a  b ", "a\n\n b", "▁", "▁▁a ▁", "\n", "\t x", "<s> hi </s><unk>", "héllo 世界 🙂🙂", "\x00a", "a" * 3000, "ab " * 50, "==========", " " * 100 + "x", "<0x0A>", "x\r\ny", "ﬁ Å"]


@pytest.fixture(scope="module")
def both():
    path = P.path("piece_bpe_32k.model")
    return tokens.PrefixTokenizer(path), sp.SentencePieceProcessor(model_file=path)


def test_every_prefix(both):
    own, library = both
    random.seed(3)
    made = ["".join(random.choice("aeth \n▁ion世🙂.,=") for _ in range(random.randint(1, 50))) for _ in range(200)]
    for s in [x for x in ODD if len(x) < 200] + made:
        assert own.prefix_counts(s) == [len(library.encode(s[:n])) for n in range(len(s) + 1)], repr(s)


def test_totals(both):
    own, library = both
    assert own.totals(ODD) == [len(library.encode(s)) for s in ODD]


def test_operator(spark, both):
    path = P.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "hello world", 9), (2, None, 9), (None, "", 9), (1, "hello world", 9)], "doc_id long, text string, n_tokens int")
    cut = tokens.count_tokens(docs, path, budget=1)
    assert cut.columns == ["doc_id", "text", "n_tokens", "budget_chars"]
    assert sorted({(r["text"] or "", r["budget_chars"]) for r in cut.collect()}) == [("", 0), ("hello world", max(i for i in range(12) if len(both[1].encode("hello world"[:i])) <= 1))]
    got = tokens.count_tokens(docs, path)
    assert got.columns == ["doc_id", "text", "n_tokens"]
    n = len(both[1].encode("hello world"))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == [(0, 0), (1, n), (1, n), (2, 0)]
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


def test_truncation(spark, both):
    own, library = both
    text = "the tokenisation of internationalisation, again"
    docs = tokens.with_prefix_counts(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), P.path("piece_bpe_32k.model"))
    row = docs.select("doc_id", "prefix_counts", tokens.tokens_of_prefix(docs["prefix_counts"], 5).alias("five"), tokens.longest_prefix(docs["prefix_counts"], 4).alias("cut")).orderBy("doc_id").collect()
    assert row[1]["prefix_counts"] == [0]
    assert row[0]["five"] == len(library.encode(text[:5]))
    fits = [n for n in range(len(text) + 1) if len(library.encode(text[:n])) <= 4]
    assert row[0]["cut"] == fits[-1]


def test_longest_prefix_within_a_budget(both):
    own, library = both
    random.seed(5)
    made = ["".join(random.choice("aeth \n▁ion世🙂.,=") for _ in range(random.randint(0, 60))) for _ in range(120)] + [x for x in ODD if len(x) < 200]
    for budget in (0, 1, 3, 9):
        for s, (n, cut) in zip(made, own.totals_and_cuts(made, budget), strict=True):
            counts = [len(library.encode(s[:i])) for i in range(len(s) + 1)]
            assert (n, cut) == (counts[-1], max(i for i, c in enumerate(counts) if c <= budget)), repr(s)


def test_very_long_segments(both, monkeypatch):
    own, library = both
    random.seed(6)
    text = "".join(random.choice("abcdefXYZ0189+/é世") for _ in range(20_000))
    assert own.totals([text]) == [len(library.encode(text))]
    whole = own.table(own.segments(text)[0])
    for size in (17, 64, 999):
        monkeypatch.setattr(tokens, "WHOLE", size)
        assert own.total(own.segments(text)[0]) == whole[-1]
    monkeypatch.setattr(tokens, "CACHE", 1000)
    assert own.totals([text[:500], "a b c"] * 3) == [len(library.encode(x)) for x in [text[:500], "a b c"] * 3]
    assert own.held < 3000


def test_words():
    assert words("The CAT's; ÉTÉ\t9".encode()) == [b"the", b"cat", b"s", "ÉtÉ".encode(), b"9"]
    ids, sizes = WordIds(lambda w: crc(w) % 100).ids([b"a b a", b"", b"c"])
    assert sizes.tolist() == [3, 0, 1]
    assert ids[0] == ids[2]
    assert [(s, len(p)) for s, p in portions(pa.array([b"x" * 5] * 4), 10)] == [(0, 2), (2, 2)]
    assert np.all(np.array(ids) < 100)
