"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of terms that reveal them.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers. Each stands for several entities: the
string itself, its group (an e-mail's domain, an address's first two numbers, a phone's or card's first four digits) and
its kind, so that identifiers that differ in every text still have terms in common. The words of whole texts are counted
over the corpus, by distinct text: how many texts hold the entity, the term and the entity, the term at all. Normalised
pointwise mutual information says how strongly a term reveals an entity (1: they only occur together). Terms over
GENERALISE are replaced by a placeholder, over REMOVE they are removed, wherever they occur in a text that
holds them. SUPPORT texts must hold a pair before it counts.

DataFrame functions only. Positions come from the lengths of what lies between the matches of a pattern. Patterns are
written with possessive repeats, which need no stack for long runs, and begin at the start of a run or where the last
match ended, which keeps long runs linear; both match what the plain patterns match. Running sums over the matches go by
blocks, and what is cut out of a text is cut out of its bytes, so that a text of a million matches is no trouble.

Defined results: a null or empty text has no spans; exact copies of a text count once in the statistics and each get
its spans; rows that repeat a document get equal results; null ids pass; an empty table gives an empty table; report()
ignores other columns, sanitise() passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Quick tests that a text with a valid match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: A term's letters.
TERM = r"\p{L}{3,}"
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.85


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        digits = F.reverse(F.regexp_replace(m, r"[\x20-]", ""))

        def step(total: Column, i: Column) -> Column:
            d = F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
            return total + F.when(d > 9, d - 9).otherwise(d)

        luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0
        return F.when(F.length(digits).between(13, 19), luhn).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _cut_by(rows: DataFrame, name: str, pattern: Column | str, hint: Column, text: str = "text") -> DataFrame:
    """rows with array columns m_<name>, the matches in `text`, and g_<name>, what lies between them; both null without any."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    rows = rows.withColumn(f"m_{name}", F.when(hint, F.regexp_extract_all(text, pattern, F.lit(0))))
    return rows.withColumn(f"g_{name}", F.when(F.size(f"m_{name}") > 0, F.split(text, pattern, -1)))


def _running(values: Column, op) -> Column:
    """array<int> of op over the first 1, 2, .. values, from 0. Blocks of about a root of the length keep what is copied at length ** 1.5."""
    none = F.array().cast("array<int>")

    def blocks(v: Column, width: Column) -> Column:
        def block(done: Column, k: Column) -> Column:
            before = F.coalesce(F.element_at(F.get(done, F.size(done) - 1)["out"], -1), F.lit(0))
            one = F.aggregate(F.slice(v, k * width + 1, width), F.struct(before.alias("at"), none.alias("out")), step)
            return F.concat(done, F.array(one))

        start = F.array().cast("array<struct<at:int,out:array<int>>>")
        done = F.aggregate(F.sequence(F.lit(0), ((F.size(v) - 1) / width).cast("int")), start, block)
        return F.flatten(F.transform(done, lambda b: b["out"]))

    def step(acc: Column, x: Column) -> Column:
        now = op(acc["at"], x)
        return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

    return _let(values, lambda v: _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda w: F.when(w > 0, blocks(v, w)).otherwise(none)))


def _let(value: Column, of) -> Column:
    """of(value), with value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _placed(name: str) -> Column:
    """array<struct<start, end, bstart, bend, i>> of the matches, in code points and in bytes from 0; empty without any. i: the match's position."""
    m, g = F.col(f"m_{name}"), F.col(f"g_{name}")
    none = F.array().cast("array<struct<start:int,end:int,bstart:int,bend:int,i:int>>")
    ends = lambda size: _running(F.transform(m, lambda x, i: size(x) + size(F.get(g, i))), _sum)
    spans = F.transform(F.arrays_zip(ends(F.length).alias("c"), ends(F.octet_length).alias("b"), m.alias("m")), lambda x, i: F.struct(
        (x["c"] - F.length(x["m"])).alias("start"), x["c"].alias("end"), (x["b"] - F.octet_length(x["m"])).alias("bstart"), x["b"].alias("bend"), i.alias("i")))
    return F.when(F.size(m) > 0, spans).otherwise(none)


def _key(docs: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"), *kept)


def base_spans(rows: DataFrame) -> DataFrame:
    """rows with array<struct<start, end, bstart, bend, i>> s_<kind> of the valid matches of each kind in `text`, and the m_ and g_ columns they come from."""
    for kind in KINDS:
        hint = F.contains("text", F.lit("@")) if kind == "email" else F.col("text").rlike(HINTS[kind])
        rows = _cut_by(rows, kind, PATTERNS[kind], hint)
    for kind in KINDS:
        rows = rows.withColumn(f"s_{kind}", _checked(kind))
    return rows


def _checked(kind: str) -> Column:
    m = F.col(f"m_{kind}")
    return F.filter(_placed(kind), lambda s: _valid(kind, F.get(m, s["i"])))


def _entities(kind: str, m: Column) -> Column:
    """The entities that an identifier stands for: itself, its group, its kind."""
    m = F.lower(m)
    digits = F.regexp_replace(m, "[^0-9]", "")
    group = {"email": F.concat(F.lit("@"), F.substring_index(m, "@", -1)), "ip": F.substring_index(m, ".", 2)}.get(kind, F.substring(digits, 1, 4))
    return F.array(F.concat(F.lit(f"{kind}:="), m), F.concat(F.lit(f"{kind}:~"), group), F.lit(f"{kind}:"))


def entities(docs: DataFrame) -> DataFrame:
    """(mark, entity): the distinct entities of the valid base spans of each distinct text."""
    spans = base_spans(_key(docs).select("mark", "text"))
    of = lambda kind: F.flatten(F.transform(f"s_{kind}", lambda s: _entities(kind, F.get(F.col(f"m_{kind}"), s["i"]))))
    return spans.select("mark", F.explode_outer(F.array_distinct(F.concat(*map(of, KINDS)))).alias("entity")).dropna().distinct()


def _terms(text: Column) -> Column:
    """The distinct terms of a text, without the words that are parts of an address (no other kind has letters)."""
    free = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(free), F.lit(TERM), F.lit(0)))


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(term, strength, kind) of terms that reveal an entity, and (doc_id, mark, term, strength) of the documents that hold one."""
    held = common.cut(entities(docs))
    counted = common.cut(held.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support))
    near = common.cut(held.join(common.small(counted), "entity").groupBy("mark").agg(F.collect_list(F.struct("entity", "n_e")).alias("own")))
    keyed = _key(docs)
    # copies of a text weigh as one; every word is counted, in one aggregate that combines before its shuffle
    copies = common.cut(keyed.groupBy("mark").agg(F.count("*").alias("copies")).filter("copies > 1"))
    surplus = copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0
    n = F.lit(keyed.count() - surplus)
    bag = keyed.select("doc_id", "mark", _terms(F.col("text")).alias("terms"))
    weighed = bag.join(common.small(copies), "mark", "left").select((F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("w"), F.explode_outer("terms").alias("term"))
    # the terms of whole texts that hold an entity, a copy once
    told = bag.join(common.small(near), "mark").select("mark", "terms", "own").dropDuplicates(["mark"])
    pairs = told.select(F.explode_outer("own").alias("e"), "terms").select("e.entity", "e.n_e", F.explode_outer("terms").alias("term")).dropna()
    pairs = common.cut(pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support))
    if pairs.isEmpty():  # keeps the schema, reads no text
        weighed, bag = weighed.limit(0), bag.limit(0)
    totals = weighed.dropna().groupBy("term").agg(F.round(F.sum("w")).alias("n_t"))
    both = pairs.join(totals, "term")
    p = F.col("n_et") / n
    npmi = F.when(p >= 1, F.lit(0.0)).otherwise(F.log2(F.col("n_et") * n / (F.col("n_e") * F.greatest("n_t", "n_et"))) / -F.log2(p))
    strongest = both.withColumn("strength", npmi).filter(F.col("strength") >= least).groupBy("term").agg(F.max(F.struct("strength", "entity")).alias("top"))
    terms = common.cut(strongest.select("term", "top.strength", F.substring_index("top.entity", ":", 1).alias("kind")))
    held = bag.select("doc_id", "mark", F.explode_outer("terms").alias("term")).join(common.small(terms), "term").select("doc_id", "mark", "term", "strength")
    return terms, held


def find(docs: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """(doc_id, mark, text, spans) per row of docs and its kept columns; spans: array<struct<kind, start, end, bstart, bend, removed>>, base kinds first, then `term`.

    Terms are looked for between addresses; identifiers of the other kinds hold no letters.
    """
    _, held = disclosing_terms(docs)
    split = lambda gone: F.collect_set(F.when((F.col("strength") >= REMOVE) == gone, F.col("term")))
    per_doc = common.cut(held.groupBy("doc_id", "mark").agg(split(False).alias("own_general"), split(True).alias("own_removed")))
    few = common.small(per_doc)
    keyed = _key(docs, kept)
    rows = base_spans(keyed.join(few, keyed["doc_id"].eqNullSafe(few["doc_id"]) & (keyed["mark"] == few["mark"]), "left").select(*[keyed[c] for c in keyed.columns], "own_general", "own_removed"))
    blank = lambda i: F.repeat(F.lit(" "), F.coalesce(F.octet_length(F.get("m_email", i)), F.lit(0)))  # addresses are ASCII: as many bytes as code points
    masked = F.array_join(F.transform("g_email", lambda x, i: F.concat(x, blank(i))), "")
    rows = rows.withColumn("masked", F.when(F.size("m_email") > 0, masked).otherwise(F.col("text")))
    for name in ("general", "removed"):
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(f"own_{name}", "|"), F.lit(r")(?!\p{L})"))
        rows = _cut_by(rows, name, pattern, F.size(f"own_{name}") > 0, "masked").withColumn(f"s_{name}", _placed(name))

    def as_spans(name: str, kind: str, removed: bool) -> Column:
        return F.transform(f"s_{name}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["bstart"].alias("bstart"), s["bend"].alias("bend"), F.lit(removed).alias("removed")))

    terms = F.concat(as_spans("general", "term", False), as_spans("removed", "term", True))
    return rows.select(*keyed.columns, F.concat(*[as_spans(k, k, False) for k in KINDS], F.when(F.size(terms) > 0, F.array_sort(terms)).otherwise(terms)).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sanitised() -> Column:
    """The text of rows of find() with what its spans cover replaced. Spans that overlap are replaced together, by what stands for the first."""
    at = F.array_sort(F.transform("spans", lambda s: F.struct(s["bstart"].alias("a"), (-s["bend"]).alias("z"), F.when(s["removed"], "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">"))).alias("put"))))

    def joined(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: -x["z"]), F.greatest)
        return _let(F.struct(F.col("text").cast("binary").alias("raw"), reach.alias("reach")), lambda x: pieces(s, x["raw"], x["reach"]))

    def pieces(s: Column, raw: Column, reach: Column) -> Column:
        done = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))  # where the spans before end
        parts = F.transform(s, lambda x, i: F.when(x["a"] >= done(i), F.concat(F.substring(raw, done(i) + 1, x["a"] - done(i)).cast("string"), x["put"])).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), F.substring(raw, F.element_at(reach, -1) + 1, F.octet_length("text")).cast("string"))

    return F.when(F.size("spans") > 0, _let(at, joined)).otherwise(F.col("text"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<kind>..., base_sha256, spans, n_term, n_removed, sanitised_sha256) per row of docs. n_term: terms generalised or removed."""
    found = find(docs).withColumn("clean", _sanitised())
    count = lambda of, name: F.size(F.filter("spans", of)).cast("long").alias(name)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    of_kind = lambda k: count(lambda s: s["kind"] == k, f"n_{k}")
    kinds = list(map(of_kind, (*KINDS, "term")))
    return found.select("doc_id", *kinds[:-1], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), kinds[-1], count(lambda s: s["removed"], "n_removed"), F.sha2("clean", 256).alias("sanitised_sha256"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with base spans of the text replaced by <kind>, terms generalised to <term> or removed by their strength; a null text becomes empty."""
    own, away = common.hidden(docs, ("doc_id", "text"))
    found = find(own, list(away.values()))
    back = [F.col(away.get(c, c)).alias(c) if c != "text" else F.col("clean").alias(c) for c in docs.columns]
    return found.withColumn("clean", _sanitised()).select(*back)
