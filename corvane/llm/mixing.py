"""Mixing to target weights by soft membership, in DataFrame functions only.

A naive Bayes classifier over hashed words learns domains from a labelled table, by counting. It gives every document
posterior probabilities of the domains; its log-likelihoods are averaged over a document's words and sharpened by
EVIDENCE words, so that long documents don't all become certain. Then nonnegative rates, one a document, are fitted by
projected gradient descent on the squared differences between expected domain token totals and their targets. All rates
move at once. While no rate meets its bound, a step's totals follow from the second moments of the posteriors, a few sums
taken once; where the bound holds, one aggregate of a few numbers comes back from the cluster for each step.

The default total is the largest that any domain's tokens call for, raised until the smallest rate of a document is 1:
scarce domains are repeated, none is thinned. Where rates over 0 can't meet the targets, all rates are kept at 1 or more
and the totals come as near to the targets as that allows; only a target of 0 leaves documents out. The number of copies is the rate rounded up or down by a hash of the document, so its
expectation is the rate.

Defined results: a null or empty text has no tokens and the prior as its posteriors; null labels are left out; targets
of domains without labels are dropped and the rest scaled to 1; without any labelled row all rates are 1; rows that
repeat a document get equal rates; an empty table gives an empty table; input columns that bear the name of an added
one are replaced; of labels that contradict each other the first as JSON counts. Targets that the rates don't meet within
TOLERANCE give a warning with the totals.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Buckets of words; labelled rows of the fit, by hash of their id.
BUCKETS, SAMPLE_ROWS = 4096, 20_000
EVIDENCE, STEPS, FREE_STEPS, TOLERANCE = 20.0, 40, 10_000, 1e-6
SEED = 17
#: Target shares of tokens of the default domains.
TARGETS = {"en": 0.45, "de": 0.2, "fr": 0.15, "es": 0.15, "low": 0.05}
#: Between words: ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def default_domain() -> Column:
    """Domain of a row of documents joined with labels: its language if its quality is 1, else `low`."""
    return F.when(F.col("quality") == 0, F.lit("low")).when(F.col("quality") == 1, F.col("lang"))


def _buckets(text: Column) -> Column:
    """Word buckets of a text, counted from 1."""
    return F.transform(F.array_remove(F.split(F.lower(text), BETWEEN), ""), lambda w: (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) + 1).cast("int"))


def _constant(numbers: Sequence[float]) -> Column:
    """array<double> of the numbers, from one string that the optimiser folds: a literal for each costs the driver a call and an expression."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


class Domains:
    """Log-likelihoods by domain and bucket: names, log priors, weights."""

    def __init__(self, names: Sequence[str], priors: Sequence[float], weights: Sequence[Sequence[float]]):
        self.names, self.priors, self.weights = list(names), list(priors), [list(w) for w in weights]


def train(docs: DataFrame, labels: DataFrame, domain: Column, names: Sequence[str]) -> Domains | None:
    """Classifier of the named domains from docs joined with labels on doc_id; None without labelled rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in labels.columns])
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    own = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source")]
    few = docs.select(*own).join(F.broadcast(rows), "doc_id").select(domain.alias("domain"), _text().alias("text")).filter(F.col("domain").isin(list(names)))
    words = few.select("domain", F.explode_outer(_buckets(F.col("text"))).alias("bucket"))
    counted = words.groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect()  # a row a domain and bucket at most
    docs_of = {r["domain"]: r["count"] for r in few.groupBy("domain").count().collect()}
    if not docs_of:
        return None
    found = [n for n in names if n in docs_of]
    count = {n: [0.5] * BUCKETS for n in found}
    for r in counted:
        if r["bucket"] is not None:
            count[r["domain"]][r["bucket"] - 1] += r["n"]
    from math import log

    weights = [[log(x / sum(count[n])) for x in count[n]] for n in found]
    whole = sum(docs_of.values())
    return Domains(found, [log(docs_of[n] / whole) for n in found], weights)


def posteriors(docs: DataFrame, model: Domains) -> DataFrame:
    """docs with tokens (words) and array<double> posterior, in the order of model.names."""
    base = common.drop_present(docs, "tokens", "posterior")
    rows = base.withColumn("__b", _buckets(_text())).withColumn("tokens", F.size("__b").cast("long"))

    def total(weights: list[float]) -> Column:
        table = _constant(weights)
        return F.aggregate("__b", F.lit(0.0), lambda acc, b: acc + F.element_at(table, b))

    scale = F.lit(EVIDENCE) / F.greatest(F.col("tokens").cast("double"), F.lit(EVIDENCE))
    logs = F.array(*[F.lit(p) + total(w) * scale for p, w in zip(model.priors, model.weights, strict=True)])
    rows = rows.withColumn("__l", logs).drop("__b")
    rows = rows.withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l")))).drop("__l")
    rows = rows.withColumn("__s", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x))
    return rows.withColumn("posterior", F.transform("__e", lambda x: x / F.col("__s"))).drop("__e", "__s")


def fit_rates(members: DataFrame, targets: Sequence[float], total: float | None = None, steps: int = STEPS) -> tuple[Column, list[float], list[float]]:
    """The rate of a row of members (tokens, posterior) as a column, expected totals under these rates, and their targets.

    A rate's gradient is that of its tokens' worth: the residuals of its domains, each in units of what the domain has,
    weighted by the posterior. Steps that meet no bound add up to one; the rate's column grows only where the bound held.
    Without a total, no rate is under 1 unless a target is 0.
    """
    d = len(targets)
    p = [F.get("posterior", F.lit(j)) for j in range(d)]
    sums = [F.sum(F.col("tokens") * p[j]) for j in range(d)] + [F.sum(F.col("tokens") * p[j] * p[k]) for j in range(d) for k in range(d)]
    got = [float(x or 0) for x in members.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]
    have, moments = got[:d], [got[d + j * d : d + j * d + d] for j in range(d)]
    whole = sum(have)
    live = [j for j in range(d) if have[j] > 0 and targets[j] > 0]
    if not live or whole <= 0:
        return F.lit(1.0), have, have
    share = sum(targets[j] for j in live)
    part = [targets[j] / share if j in live else 0.0 for j in range(d)]
    raised = total is None
    if raised:
        total = max(have[j] / part[j] for j in live)
    goal = [x * total for x in part]
    rate, now, least = _descend(members, have, moments, goal, total, steps, 0.0)
    if raised and 0 < least < 1:  # all is in proportion to the total
        rate, now, goal = F.greatest(F.lit(1.0), rate / F.lit(least)), [x / least for x in now], [x / least for x in goal]
    elif raised and least <= 0 and all(part[j] > 0 for j in range(d) if have[j] > 0):
        rate, now, _ = _descend(members, have, moments, goal, total, steps, 1.0)
    if max(abs(g - n) for g, n in zip(goal, now, strict=True)) > TOLERANCE * total:
        warnings.warn(f"expected domain totals {now} differ from their targets {goal}", stacklevel=2)
    return rate, now, goal


def _descend(members: DataFrame, have: list[float], moments: list[list[float]], goal: list[float], total: float, steps: int, bound: float) -> tuple[Column, list[float], float]:
    """Rates of at least bound, expected totals under them, and the smallest rate before the bound held."""
    d, whole = len(goal), sum(have)
    level = total / whole
    start: Column = F.lit(level)
    far = lambda now: max(abs(g - n) for g, n in zip(goal, now, strict=True)) > TOLERANCE * total
    pulled = lambda now: [(goal[j] - now[j]) / have[j] if have[j] > 0 else 0.0 for j in range(d)]
    moved = lambda pull, start: sum((F.lit(m) * F.get("posterior", F.lit(j)) for j, m in enumerate(pull)), start)
    # steps without a bound need the moments alone
    now, pull = [x * level for x in have], [0.0] * d
    for _ in range(FREE_STEPS):
        if not far(now):
            break
        pull = [a + m for a, m in zip(pull, pulled(now), strict=True)]
        now = [level * have[j] + sum(pull[k] * moments[k][j] for k in range(d)) for j in range(d)]
    least = members.agg(F.min(moved(pull, start))).first()[0]
    if least is None or least >= bound:
        return F.greatest(F.lit(bound), moved(pull, start)), now, level if least is None else float(least)
    rate, now, low, pull = start, [x * level for x in have], level, [0.0] * d
    for _ in range(steps):
        if not far(now):
            break
        pull = [a + m for a, m in zip(pull, pulled(now), strict=True)]
        rows = members.withColumn("__m", moved(pull, start)).withColumn("__r", F.greatest(F.lit(bound), "__m"))
        *sums, least = rows.agg(*[F.sum(F.col("__r") * F.col("tokens") * F.get("posterior", F.lit(j))) for j in range(d)], F.min("__m")).first()
        rate = F.greatest(F.lit(bound), moved(pull, start))
        now = [float(x or 0) for x in sums]
        low = low if least is None else float(least)
        if low < bound:  # the projection was at work: later steps start from where it led
            start, pull = rate, [0.0] * d
    return rate, now, low


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None, total: float | None = None) -> DataFrame:
    """(doc_id, domain, tokens, posterior, rate, copies) per row of docs. domain: the likeliest; mark: hash of the text."""
    targets = TARGETS if targets is None else targets
    model = train(docs, labels, default_domain() if domain is None else domain, list(targets))
    own = docs.select("doc_id", _text().alias("text"))
    if model is None:
        rows, rate, top = own.select("doc_id", F.xxhash64("text").alias("mark"), F.size(_buckets(F.col("text"))).cast("long").alias("tokens"), F.array().cast("array<double>").alias("posterior")), F.lit(1.0), F.lit(None).cast("string")
    else:  # what the fit reads is small: a count and a few probabilities a document
        rows = common.cut(posteriors(own, model).select("doc_id", F.xxhash64("text").alias("mark"), "tokens", "posterior"))
        rate, _, _ = fit_rates(rows, [targets[n] for n in model.names], total)
        top = F.get(F.array(*map(F.lit, model.names)), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    chance = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "mark"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")
    return rows.withColumn("rate", rate).select("doc_id", "mark", top.alias("domain"), "tokens", "posterior", "rate", copies)


ADDED = ("domain", "tokens", "rate", "copies")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None, total: float | None = None) -> DataFrame:
    """docs with domain, tokens, rate and copies; documents of 0 copies are dropped (with the default total there are none, unless a target is 0)."""
    base = common.drop_present(docs, *ADDED)
    one = common.cut(rates(docs, labels, targets, domain, total).select("doc_id", "mark", *ADDED).dropDuplicates(["doc_id", "mark"]).filter("copies > 0"))
    few = common.small(one.withColumnRenamed("doc_id", "__id").withColumnRenamed("mark", "__mark"))
    return base.join(few, base["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(_text()) == F.col("__mark"))).drop("__id", "__mark")
