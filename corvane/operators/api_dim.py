"""The API's classes and methods as dimension tables, and look-ups in them as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Rows up to which the dimension is sent to every task. It is as large as an API, not as the data; look-ups share one count of it.
MOST_CLASSES = 200_000


def api_classes(docs: DataFrame) -> DataFrame:
    """A row a class from documentation records; of repeated classes the first by module stays."""
    rows = docs.groupBy(F.col("class_name").alias("class")).agg(F.min_by(F.struct("module_name", "role", "visibility_score", "action_phrase", "synopsis", "input_datatype", "output_datatype", "class_doc"), "module_name").alias("r"))
    return rows.select("class", F.col("r.module_name").alias("module"), *[f"r.{c}" for c in ("role", "visibility_score", "action_phrase", "synopsis", "input_datatype", "output_datatype", "class_doc")])


def api_methods(docs: DataFrame) -> DataFrame:
    """(class, method, signature, doc): the first line of a method's text is its signature."""
    sections = docs.select(F.col("class_name").alias("class"), F.explode("structured_docs.sections").alias("section", "data"))
    each = sections.select("class", F.explode("data.methods").alias("method", "doc"))
    return each.select("class", "method", F.element_at(F.split(F.trim("doc"), "\n"), 1).alias("signature"), "doc")


def dimension(rows: DataFrame) -> DataFrame:
    """rows for a join: sent to every task if there are few enough. Rows of one plan are counted once in a session."""
    key = (rows.sparkSession.sparkContext.applicationId, rows.semanticHash())
    known = next((few for other, few in _FEW.get(key, ()) if other.sameSemantics(rows)), None)
    if known is None:
        known = rows.limit(MOST_CLASSES + 1).count() <= MOST_CLASSES
        _FEW.setdefault(key, []).append((rows, known))
    return F.broadcast(rows) if known else rows


_FEW: dict[tuple[str, int], list[tuple[DataFrame, bool]]] = {}


def role(col: str = "role") -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("utility"))


def visibility(col: str = "visibility_score") -> Column:
    """0 counts as unknown."""
    return F.coalesce(F.nullif(F.col(col), F.lit(0.0)), F.lit(0.5))


def phrase(class_col: str, col: str = "action_phrase") -> Column:
    return F.coalesce(text.capitalize_first(F.nullif(F.col(col), F.lit(""))), text.fallback_phrase(class_col))


def lookup(rows: DataFrame, classes: DataFrame, on: str = "class", how: str = "left") -> DataFrame:
    """rows with the fields of their class. how: left, inner, left_semi (known classes) or left_anti (unknown ones)."""
    return rows.join(dimension(classes), on, how)


def search_classes(classes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Classes with query in their name, then in their synopsis, by name."""
    q = query.lower()
    place = F.when(F.contains(F.lower("class"), F.lit(q)), 0).when(F.contains(F.lower(F.coalesce("synopsis", F.lit(""))), F.lit(q)), 1)
    return classes.withColumn("place", place).filter("place IS NOT NULL").orderBy("place", "class").limit(limit)


def class_doc(classes: DataFrame, name: str) -> DataFrame:
    return class_info(classes, name).select("class_doc")


def class_synopsis(classes: DataFrame, name: str) -> DataFrame:
    return class_info(classes, name).select("synopsis")


def class_methods(methods: DataFrame, name: str) -> DataFrame:
    """Names of a class's methods, in order."""
    return method_info(methods, name).select("method").orderBy("method")


def method_doc(methods: DataFrame, name: str, method: str) -> DataFrame:
    return method_info(methods, name, method).select("doc")


def method_signature(methods: DataFrame, name: str, method: str) -> DataFrame:
    return method_info(methods, name, method).select("signature")


def class_info(classes: DataFrame, name: str) -> DataFrame:
    return classes.filter(F.col("class") == name)


def method_info(methods: DataFrame, class_name: str, method: str | None = None) -> DataFrame:
    own = methods.filter(F.col("class") == class_name)
    return own if method is None else own.filter(F.col("method") == method)


def semantic_methods(docs: DataFrame, class_name: str) -> DataFrame:
    return docs.filter(F.col("class_name") == class_name).select(F.explode("semantic_methods").alias("method"))


def module_classes(classes: DataFrame, module: str) -> DataFrame:
    return classes.filter(F.col("module") == module).select("class").orderBy("class")
