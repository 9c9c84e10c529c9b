"""Identifier spans against Python's regular expressions; terms that give an entity away."""

import hashlib
import re

import pytest

from corvane.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


TEXTS = [
    None, "", "none", "a@b.c+d@e.f a@b.c@d.e x..y@z-1.co.uk 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4",
    "+1 (234) 567-8901 4111 1111 1111 1111 and 4111-1111-1111-1112 é🙂 q@w.er +12", "0" * 16 + " 00000000.0.0.0 +0 0 0 0 0 0 0 0 0",
    "1" * 5000 + " " + "a" * 5000 + " " + "1." * 5000 + " x@y" + ".z" * 3000 + " " + "1 " * 5000, "@@ a@ @b.c a@b a@b. a@b.c.",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (1, TEXTS[1]), (None, TEXTS[3])], "doc_id long, text string")
    for r in pii.report(docs).collect():
        want = base(TEXTS[3 if r["doc_id"] is None else r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x == k for x, *_ in want) for k in PLAIN]
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert r["spans"].startswith(written)


@pytest.fixture(scope="module")
def told(spark):
    filler = [f"common words about nothing at all number {i} " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for _ in range(5)) for i in range(200)]
    rows = [(i, f"common words {t} about nothing: Zorblatt, see boss@corp.example and words") for i, t in enumerate(["one", "two", "six", "ten", "odd"])]
    rows += [(10, "the nickname zorblatt alone"), (11, "zorblatts differ"), *((100 + i, t) for i, t in enumerate(filler))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal(spark, told):
    terms, held = pii.disclosing_terms(told)
    got = {r["term"]: r for r in terms.collect()}
    assert "zorblatt" in got
    assert "common" not in got
    assert got["zorblatt"]["kind"] == "email"
    assert 10 in {r["doc_id"] for r in held.collect()}
    spans = {r["doc_id"]: r["spans"] for r in pii.report(told).collect()}
    assert "term:13:21" in spans[10]
    assert spans[11] == ""


def test_sanitised_texts(spark, told):
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(told).collect()}
    assert "zorblatt" not in got[0].lower()
    assert "<email>" in got[0]
    assert "boss" not in got[0]
    assert got[11] == "zorblatts differ"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(docs).collect() == []
    assert pii.sanitise(docs).collect() == []


def test_identifiers_that_differ_have_terms_in_common(spark):
    far = "filler " * 40
    rows = [(i, f"Quillberg {far} words {far} person{i}@mail{i}.example") for i in range(8)]
    rows += [(8 + i, rows[i][1]) for i in range(3)]  # copies count once
    rows += [(100 + i, f"filler words of text {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    terms, held = pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["term"]: r for r in terms.collect()}
    assert got["quillberg"]["strength"] == pytest.approx(1.0)
    assert got["quillberg"]["kind"] == "email"
    assert not {"filler", "example"} & set(got)  # the latter is a part of the addresses
    assert {r["doc_id"] for r in held.filter("term = 'quillberg'").collect()} == set(range(11))


def test_texts_are_counted_exactly(spark):
    rows = [(i, f"tell{i} alpha beta a@b.example") for i in range(4)] + [(10 + i, f"alpha other{i}") for i in range(3)] + [(100 + i, f"plain {'x' * i}") for i in range(2000)] + [(9000 + i, "plain xxx") for i in range(500)]
    terms, _ = pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"))
    n = len({t for _, t in rows})
    want = __import__("math").log2(4 * n / (4 * 7)) / -__import__("math").log2(4 / n)
    assert {r["term"]: r["strength"] for r in terms.collect()}["alpha"] == pytest.approx(want, abs=1e-12)


def test_very_many_matches_take_no_square(spark):
    import time

    text = "é a@b.cd 1.2.3.4 " * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.report(docs.limit(0)).collect()
    began = time.time()
    (r,) = pii.base_spans(docs.select("text")).selectExpr("size(s_email) n", "size(s_ip) m", "s_ip[99999] last").collect()
    assert time.time() - began < 20
    assert (r["n"], r["m"]) == (100_000, 100_000)
    assert (r["last"]["start"], r["last"]["end"]) == (17 * 100_000 - 8, 17 * 100_000 - 1)
    (clean,) = pii.sanitise(docs).collect()
    assert clean["text"] == "é <email> <ip> " * 100_000
    assert time.time() - began < 60


def test_overlaps_are_replaced_together(spark):
    rows = [(1, "é +1 234 567 8901@mail.example, 4111 1111 1111 1111 +49 (30) 1234567 ü"), (2, "10.20.30.40@x.yz"), (3, None)]
    docs = spark.createDataFrame([(i, t, "keep", 5) for i, t in rows], "doc_id long, text string, spans string, mark int")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "é <phone>, <card> <phone> ü", "keep", 5), (2, "<email>", "keep", 5), (3, "", "keep", 5)]


def test_terms_against_plain_counts(spark, told):
    """Strengths by their definition, from every pair of a term and an entity of the distinct texts."""
    from math import log2

    texts = sorted({r["text"] for r in told.collect()})
    terms = [set(re.findall(r"[^\W\d_]{3,}", re.sub(PLAIN["email"], " ", t).lower())) for t in texts]
    entities = [{x for k, a, b in base(t) for x in (f"{k}:={t[a:b].lower()}", f"{k}:~@{t[a:b].split('@')[-1].lower()}", f"{k}:")} for t in texts]
    n, want = len(texts), {}
    for e in set().union(*entities):
        n_e = sum(e in x for x in entities)
        for t in set().union(*terms):
            n_t, both = sum(t in x for x in terms), sum(e in x and t in y for x, y in zip(entities, terms, strict=True))
            if n_e >= pii.SUPPORT and both >= pii.SUPPORT:
                strength = log2(both * n / (n_e * n_t)) / -log2(both / n)
                if strength >= pii.GENERALISE:
                    want[t] = max(strength, want.get(t, -2))
    got = {r["term"]: r["strength"] for r in pii.disclosing_terms(told)[0].collect()}
    assert got == pytest.approx(want)
    assert want


def test_what_is_removed_is_reported(spark, told):
    rows = {r["doc_id"]: r for r in pii.report(told).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(told).collect()}
    for i, r in rows.items():
        assert r["sanitised_sha256"] == hashlib.sha256(clean[i].encode()).hexdigest()
        assert r["n_term"] == r["spans"].count("term:")
        assert r["n_term"] - r["n_removed"] == clean[i].count("<term>")
    assert sum(r["n_term"] for r in rows.values()) > 0
