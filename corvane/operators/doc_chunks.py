"""Chunks of API documentation: overview, constructor, methods and inheritance of each class, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import questions, text
from ..schemas import DOC_CHUNK
from . import api_dim

SHOWN_METHODS = 30


def own_methods(docs: DataFrame) -> DataFrame:
    """docs with map `own`: methods that sections `... defined here` describe, semantic ones if any are named; a later section wins."""
    entries = F.filter(F.map_entries(F.coalesce("structured_docs.sections", F.create_map().cast("map<string,struct<methods:map<string,string>>>"))), lambda e: F.contains(F.lower(e["key"]), F.lit("defined here")))
    flat = F.flatten(F.transform(entries, lambda e: F.map_entries(F.coalesce(e["value"]["methods"], F.create_map().cast("map<string,string>")))))
    wanted = F.filter(flat, lambda m: (F.size("semantic_methods") == 0) | F.array_contains("semantic_methods", m["key"]))

    def add(acc: Column, m: Column) -> Column:
        known = F.array_position(F.transform(acc, lambda x: x["key"]), m["key"])
        return F.when(known > 0, F.transform(acc, lambda x: F.when(x["key"] == m["key"], m).otherwise(x))).otherwise(F.concat(acc, F.array(m)))

    none = F.array().cast("array<struct<key:string,value:string>>")
    return docs.withColumn("own", F.aggregate(wanted, none, add))


def _chunk(kind: str, suffix: Column, content: Column, synopsis: Column, phrase: Column, asked: Column) -> Column:
    return F.struct(F.concat("class_name", F.lit("_"), suffix).alias("chunk_id"), F.lit(kind).alias("chunk_type"), content.alias("content"), synopsis.alias("synopsis"), phrase.alias("action_phrase"), asked.alias("queries"))


def chunk_docs(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Chunks with the columns of DOC_CHUNK and `pos`, their order in the class. classes: the dimension for parents' modules."""
    name, phrase = F.col("class_name"), F.col("action_phrase")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = own_methods(docs).withColumn("parent", text.superclass("class_doc"))
    dim = (api_dim.api_classes(docs) if classes is None else classes).select(F.col("class").alias("parent"), F.col("module").alias("parent_module"))
    rows = rows.join(api_dim.dimension(dim), "parent", "left")
    class_question = questions.class_to_question(F.lower(phrase))

    public = F.filter(F.transform("own", lambda m: m["key"]), lambda k: ~F.startswith(k, F.lit("_")))
    listed = F.when(F.size(public) > 0, say("\n## Methods\n", text.top_n_list(public, SHOWN_METHODS))).otherwise(F.lit(""))
    overview = _chunk(
        "class_overview", F.lit("overview"), say("# ", name, "\n\n", F.col("class_doc"), "\n", listed), say("Overview of ", name, ": ", F.col("synopsis")),
        F.when(phrase != "", say("overview of ", phrase)).otherwise(say(name, " overview")),
        text.dedupe_ci(F.array(class_question, say("What is ", name, "?"), say("What does ", name, " do?"), say("How do I use ", name, "?"))),
    )
    doc_of = lambda method: F.get(F.filter("own", lambda m: m["key"] == method), F.lit(0))["value"]
    made = F.coalesce(F.nullif(doc_of("__new__"), F.lit("")), doc_of("__init__"), F.lit(""))
    constructor = _chunk(
        "constructor", F.lit("constructor"),
        say("# ", name, " Constructor\n\n", text.class_to_var(name), " = ", name, "()", F.when((made != "") & ~F.contains(made, F.lit("Initialize self")), say("\n\n## Constructor Documentation\n", made)).otherwise(F.lit(""))),
        say("Create ", name, F.when(F.col("synopsis") != "", say(" - ", F.col("synopsis"))).otherwise(F.lit(""))),
        say(name, " constructor"), F.array(say("How to create ", name, "?"), say(name, " constructor")),
    )

    def method(m: Column) -> Column:
        k, body = m["key"], F.coalesce(m["value"], F.lit(""))
        line = text.last_matching_line(F.regexp_replace(body, r"^\s+|\s+$", ""), k)
        question = F.when(phrase != "", questions.method_to_question(k, F.lower(phrase)))
        return _chunk(
            "method", k, say("# ", name, ".", k, "\n\n", F.regexp_replace(body, r"^\s+|\s+$", "")),
            say(name, ".", k, "()", F.when(line != "", say(" - ", line)).otherwise(F.lit(""))), say(name, " ", text.camel_to_words(k)),
            text.dedupe_ci(F.array(question, say("How to use ", name, ".", k))),
        )

    module = F.when(F.coalesce("parent_module", F.lit("")) != "", say("\n**Superclass Module:** `", F.col("parent_module"), "`")).otherwise(F.lit(""))
    inheritance = _chunk(
        "inheritance", F.lit("inheritance"), say("# ", name, " Inheritance\n\n**Superclass:** `", F.col("parent"), "`", module), say(name, " inherits from ", F.col("parent")),
        F.lit(""), F.array(say("What does ", name, " inherit from?"), say(name, " parent class"), say(name, " base class")),
    )
    all_ = F.concat(
        F.when(F.col("class_doc") != "", F.array(overview)).otherwise(F.array()), F.array(constructor), F.transform("own", method),
        F.when(F.col("parent") != "", F.array(inheritance)).otherwise(F.array()),
    )
    rows = rows.withColumn("chunks", all_).select("class_name", "role", "visibility_score", "module_name", "input_datatype", "output_datatype", F.posexplode_outer("chunks").alias("pos", "c"))
    given = {"vtk_class": F.col("class_name"), "role": F.col("role"), "visibility_score": F.col("visibility_score"), "module": F.col("module_name"), "input_datatype": F.col("input_datatype"), "output_datatype": F.col("output_datatype")}
    return rows.select(*[(given.get(f.name) if f.name in given else F.col(f"c.{f.name}")).alias(f.name) for f in DOC_CHUNK.fields], "pos")


def count_by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type")).agg(F.count("*").alias("n")).orderBy("chunk_type")
