"""Corpus pipeline: toxicity, line dedup, near-duplicate removal, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, in
their order and with their values: n_chars follows the text where lines are dropped, nothing else changes, and a null text
stays null. Columns that an operator adds meet no column of docs, whatever its name, for the operators get the other
columns of docs under private names. The last stage adds domain, tokens, rate and copies; where docs has a column of such
a name, that one stays and the added one is called mixing_<name>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common, lines, minhash, mixing, toxicity, winnow


def _back(docs: DataFrame, away: dict[str, str]) -> list[Column]:
    """The columns of docs, from an operator's result over common.hidden(docs)."""
    return [F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold of their language. The classifier learns from fit folds of labels alone."""
    own, away = common.hidden(docs, ("doc_id", "text", "lang"))
    model = toxicity.train(own, common.table(spark, sf_dir, "labels"), toxicity.fold() != 0)
    kept = toxicity.score(own, model).filter(~F.col("rejected"))
    return kept.select(*_back(docs, away))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long lines that repeat in others."""
    own, away = common.hidden(docs, ("doc_id", "text", "n_chars"))
    kept = lines.dedup_lines(own)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return kept.select(*_back(docs, away))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    own, away = common.hidden(docs, ("doc_id", "text"))
    kept = minhash.dedup(own)
    return kept.select(*_back(docs, away))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    own, away = common.hidden(docs, ("doc_id", "text"))
    kept = winnow.decontaminate(own, common.table(spark, sf_dir, "benchmark"))
    return kept.select(*_back(docs, away))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their domain, tokens, rate and copies; domains' expected totals of tokens meet the target weights."""
    own, away = common.hidden(docs, ("doc_id", "text", "lang"))
    mixed = mixing.mix(own, common.table(spark, sf_dir, "labels"))
    taken = {c.lower() for c in docs.columns}
    return mixed.select(*_back(docs, away), *[F.col(c).alias(f"mixing_{c}" if c in taken else c) for c in mixing.ADDED])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_domains),
]

#: SQL can't express a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what each stage keeps is written to the shared folder and read again, and deleted once the next is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = common.store(stage(spark, docs, sf_dir))
        if before is not None:
            common.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
