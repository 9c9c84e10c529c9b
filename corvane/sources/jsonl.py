"""JSON-lines and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_CODE, RAW_DOC


def read_jsonl(spark: SparkSession, paths: str | list[str], schema) -> DataFrame:
    """Records by schema; blank lines are skipped, lines that aren't JSON come as rows of nulls with _corrupt_record."""
    from pyspark.sql import types as T

    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(paths)


def read_code_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(example_id, code) of all records; a record without id is `unknown`, one without code has an empty one."""
    raw = read_jsonl(spark, paths, RAW_CODE)
    return raw.select(F.coalesce("id", F.lit("unknown")).alias("example_id"), F.coalesce("code", F.lit("")).alias("code"))


def with_code(records: DataFrame) -> DataFrame:
    return records.filter("code <> ''")


def read_code(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(example_id, code) of records with code."""
    return with_code(read_code_records(spark, paths))


def read_docs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documentation records with a class name, defaults filled in."""
    return with_doc_defaults(read_jsonl(spark, paths, RAW_DOC).drop("_corrupt_record"))


def with_doc_defaults(raw: DataFrame) -> DataFrame:
    empty = [c for c in ("class_name", "module_name", "class_doc", "synopsis", "action_phrase", "input_datatype", "output_datatype")]
    filled = raw.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in empty})
    filled = filled.withColumns({"role": F.coalesce("role", F.lit("utility")), "visibility_score": F.coalesce("visibility_score", F.lit(0.3)), "semantic_methods": F.coalesce("semantic_methods", F.array().cast("array<string>"))})
    return filled.filter("class_name <> ''")


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """Overwrite, so that a repeated run gives the same files; several sources are united before."""
    chunks.write.mode("overwrite").json(path)


def write_parquet(chunks: DataFrame, path: str, *partitions: str) -> None:
    (chunks.write.partitionBy(*partitions) if partitions else chunks.write).mode("overwrite").parquet(path)
