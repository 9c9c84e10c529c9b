"""Reports on chunks: samples by role, counts of what a build read and made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .retriever import sample_per_group

SHOWN_CONTENT, SHOWN_QUERIES = 1500, 3


def sample_by_role(chunks: DataFrame, n: int, *order: str) -> DataFrame:
    """First n chunks of each role with cut content and their first queries, by role."""
    shown = sample_per_group(chunks, "role", n, *order)
    have = [c for c in ("chunk_id", "class_name", "vtk_class", "synopsis", "action_phrase") if c in chunks.columns]
    queries = [F.slice("queries", 1, SHOWN_QUERIES).alias("queries")] if "queries" in chunks.columns else []
    return shown.select("role", "rn", *have, text.preview("content", SHOWN_CONTENT).alias("content"), *queries).orderBy("role", "rn")


def roles(chunks: DataFrame, n: int, *order: str) -> DataFrame:
    """Roles and how many sampled chunks each has."""
    return sample_per_group(chunks, "role", n, *order).groupBy("role").agg(F.count("*").alias("samples")).orderBy("role")


def counts(code: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records of code read, those of them without code, chunks, and files with chunks: one row."""
    made = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("example_id").alias("files_with_chunks"))
    return code.agg(F.count("*").alias("files"), F.count_if(F.col("code") == "").alias("files_without_code")).crossJoin(made)
