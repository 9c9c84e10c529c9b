"""Code chunks: files are analysed in Python, one at a time; all that follows is DataFrame work."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import questions, text
from ..functions.fixed import INTERACTION_IMPORT, RENDERING_IMPORT
from ..schemas import CODE_CHUNK
from . import api_dim
from .code_analysis import files

MEMBER = (
    "struct<variable:string,class:string,role:string,mapper:string,actor:string,properties:array<struct<variable:string,class:string>>,"
    "methods:array<string>,calls:array<struct<name:string,args:array<string>>>,source:array<string>>"
)
GROUPS = f"example_id string, chunk_no int, helper string, members array<{MEMBER}>, error string"
#: Files whose rows are held at once.
FILES = 500
#: Method calls of a class that its question list and synopsis show.
SHOWN_CALLS = 8
JOIN = " → "


def lifecycle_groups(code: DataFrame, classes: DataFrame) -> DataFrame:
    """GROUPS rows of (example_id, code). The API's classes and roles go to every task; beyond MOST_CLASSES each file gets those that it names by a join.

    Files are dealt over the partitions of a shuffle, as their analysis takes long for their bytes: a scan of a small table would be one task.
    """
    n = int(code.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = classes.select("class", api_dim.role().alias("role"))
    few = own.limit(api_dim.MOST_CLASSES + 1).collect()
    if len(few) <= api_dim.MOST_CLASSES:
        roles = code.sparkSession.sparkContext.broadcast({r["class"]: r["role"] for r in few})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _analysed(((e, c, roles.value) for e, c in zip(batch["example_id"], batch["code"], strict=True)))

        return code.select("example_id", "code").repartition(n, "example_id", "code").mapInPandas(run, GROUPS)

    def run_named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _analysed(((e, c, dict(zip(names, r, strict=True))) for e, c, names, r in zip(batch["example_id"], batch["code"], batch["names"], batch["roles"], strict=True)))

    keyed = code.select("example_id", "code", F.xxhash64("code").alias("key"))
    said = keyed.select("example_id", "key", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("class")).distinct()
    named = said.join(own, "class").groupBy("example_id", "key").agg(F.collect_list("class").alias("names"), F.collect_list("role").alias("roles"))
    none = F.array().cast("array<string>")
    both = keyed.join(named, ["example_id", "key"], "left").select("example_id", "code", F.coalesce("names", none).alias("names"), F.coalesce("roles", none).alias("roles"))
    return both.repartition(n, "example_id", "code").mapInPandas(run_named, GROUPS)


def _analysed(given: Iterable[tuple[str, str, Mapping[str, str]]]) -> Iterator[pd.DataFrame]:
    given = iter(given)
    while some := list(islice(given, FILES)):
        yield pd.DataFrame([r for e, c, roles in some for r in files.rows(e, c, roles)], columns=["example_id", "chunk_no", "helper", "members", "error"])


def lifecycles(code: DataFrame, classes: DataFrame) -> DataFrame:
    """A row a lifecycle, in the order of groups."""
    each = lifecycle_groups(code, classes).filter("chunk_no IS NOT NULL").select("example_id", "chunk_no", F.posexplode("members").alias("member_no", "m"))
    calls = F.array_join(F.transform("m.methods", lambda x: x), ",")
    return each.select("example_id", "chunk_no", "member_no", "m.variable", "m.class", "m.role", "m.mapper", "m.actor", calls.alias("methods"), F.size("m.source").cast("long").alias("statements"))


def first_by_name(calls: Column) -> Column:
    """Calls (name, args) without those whose name an earlier one has."""
    return text.let(calls, lambda a: text.let(F.transform(a, lambda c: c["name"]), lambda n: F.filter(a, lambda c, i: F.array_position(n, c["name"]) == i + 1)))


def first_calls(calls: Column) -> Column:
    """The calls that a chunk shows."""
    return F.slice(calls, 1, SHOWN_CALLS)


def joined(parts: Column) -> Column:
    """What a chunk's classes give, one after the other."""
    return F.array_join(parts, JOIN)


def first_role(members: Column) -> Column:
    """Role of the first member that has one."""
    return F.coalesce(text.first_nonempty(F.transform(members, lambda m: m["role"])), F.lit(""))


def is_pythonic(example_id: Column, mark: str = "PythonicAPI") -> Column:
    return F.contains(example_id, F.lit(mark))


def class_names(members: Column) -> Column:
    """Distinct classes of members and their properties, in order."""
    named = F.flatten(F.transform(members, lambda m: F.concat(F.array(m["class"]), F.transform(m["properties"], lambda p: p["class"]))))
    return text.dedupe_first(named)


def chunk_code(code: DataFrame, classes: DataFrame) -> DataFrame:
    """Chunks with the columns of CODE_CHUNK and `chunk_no`; (example_id, chunk_no) is their key."""
    return assemble(lifecycle_groups(code, classes).filter("chunk_no IS NOT NULL"), classes)


def assemble(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups as chunks. A group's members go with the first of its classes, so that files are analysed once and members shuffled once."""
    rows = groups.withColumn("names", class_names(F.col("members")))

    def of(cls: Column) -> Column:
        own = F.filter("members", lambda m: m["class"] == cls)
        return F.struct(
            cls.alias("class"), F.transform(own, lambda m: m["variable"]).alias("variables"),
            F.array_distinct(F.flatten(F.transform(own, lambda m: m["methods"]))).alias("methods"), first_by_name(F.flatten(F.transform(own, lambda m: m["calls"]))).alias("calls"),
        )

    whole = F.struct("helper", "members", "names").alias("group")
    used = rows.select("example_id", "chunk_no", whole, F.posexplode(F.transform("names", of)).alias("pos", "u"))
    used = used.select("example_id", "chunk_no", F.when(F.col("pos") == 0, F.col("group")).alias("group"), "pos", "u.*")
    dim = classes.select("class", "module", "visibility_score", "action_phrase", "input_datatype", "output_datatype")
    used = used.join(api_dim.dimension(dim), "class", "left").withColumn("phrase", api_dim.phrase("class"))
    shown = first_calls(F.col("calls"))
    phrases = F.filter(F.transform(shown, lambda c: questions.call_to_phrase(c["name"], c["args"])), lambda x: x.isNotNull())
    used = used.withColumn("phrases", phrases)
    part = F.when(F.size("phrases") > 0, F.concat("phrase", F.lit(" with "), F.array_join("phrases", ", "))).otherwise(F.col("phrase"))
    asked = F.concat(F.array(questions.class_to_question(F.lower("phrase"))), F.transform(shown, lambda c: questions.method_to_question(c["name"], F.lower(F.col("phrase")))))
    entry = F.struct(
        "pos", "class", "variables", "methods", F.coalesce("module", F.lit("")).alias("module"), api_dim.visibility().alias("visibility"), F.coalesce("input_datatype", F.lit("")).alias("input"),
        F.coalesce("output_datatype", F.lit("")).alias("output"), "phrase", part.alias("synopsis"), asked.alias("queries"),
    )
    by = used.groupBy("example_id", "chunk_no").agg(F.array_sort(F.collect_list(entry)).alias("c"), F.first("group", ignorenulls=True).alias("group"))  # a chunk's classes
    full = by.select("example_id", "chunk_no", "group.*", "c")
    c = F.col("c")
    get = lambda name: F.transform(c, lambda x: x[name])
    full = full.withColumn("role_", first_role(F.col("members")))
    variables = F.filter(F.transform("members", lambda m: m["variable"]), lambda v: v.isNotNull() & (v != ""))
    asked_all = text.dedupe_ci(F.flatten(get("queries")))
    queries = F.when(F.col("helper").isNotNull(), F.concat(asked_all, F.array(questions.function_to_question(F.col("helper"))))).otherwise(asked_all)
    source = F.array_join(F.flatten(F.transform("members", lambda m: m["source"])), "\n")
    given = {
        "chunk_id": F.concat(text.path_segment("example_id"), F.lit("_chunk_"), F.col("chunk_no").cast("string")), "action_phrase": joined(get("phrase")),
        "synopsis": joined(get("synopsis")), "role": F.col("role_"), "visibility_score": F.aggregate(get("visibility"), F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(c)),
        "input_datatype": _datatypes(c)[0], "output_datatype": _datatypes(c)[1], "content": F.concat(import_lines(c), F.lit("\n\n"), text.rewrite_code(source)),
        "variable_name": F.array_join(variables, ", "), "vtk_classes": F.transform(c, lambda x: F.struct(x["class"].alias("class"), x["variables"].alias("variables"), x["methods"].alias("methods"))),
        "vtk_class_names": get("class"), "queries": queries, "is_pythonic": is_pythonic(F.col("example_id")),
    }
    return full.select(*[given.get(f.name, F.col(f.name)).alias(f.name) for f in CODE_CHUNK.fields], "chunk_no")


def _datatypes(c: Column) -> tuple[Column, Column]:
    """Input and output datatypes by role."""
    role, first = F.col("role_"), F.get(c, F.lit(0))
    mapper = F.get(F.filter(c, lambda x: F.contains(x["class"], F.lit("Mapper"))), F.lit(0))
    actor = F.exists(c, lambda x: F.contains(x["class"], F.lit("Actor")))
    shown = (role == "properties") & (mapper.isNotNull() | actor)
    input_ = F.when(role == "renderer", "vtkActor").when(role.isin("infrastructure", "scene"), "vtkRenderer").when(shown, F.when(mapper.isNotNull(), mapper["input"]).otherwise("vtkMapper")).otherwise(first["input"])
    output = F.when(role == "renderer", "vtkRenderer").when(role.isin("infrastructure", "scene"), "").when(shown, "vtkActor").otherwise(first["output"])
    return input_, output


def import_lines(c: Column) -> Column:
    """Imports for side effects, then of classes by module, both in order; c: array of structs with class and module."""
    window = F.exists(c, lambda x: F.contains(x["class"], F.lit("RenderWindow")) & ~F.contains(x["class"], F.lit("Interactor")))
    interactor = F.exists(c, lambda x: F.contains(x["class"], F.lit("Interactor")))
    modules = F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: x["module"]), lambda m: m != "")))
    own = F.transform(modules, lambda m: F.concat(F.lit("from "), m, F.lit(" import "), F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda x: x["module"] == m), lambda x: x["class"]))), ", ")))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.when(window, F.array(F.lit(RENDERING_IMPORT))).otherwise(none), F.when(interactor, F.array(F.lit(INTERACTION_IMPORT))).otherwise(none), own), "\n")
