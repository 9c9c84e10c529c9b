"""Schemas of raw records, chunks and the API's classes. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()  # noqa: E741
STRINGS = T.ArrayType(S)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RAW_CODE = struct(id=S, code=S)
METHODS = T.MapType(S, S)
RAW_DOC = struct(
    class_name=S, module_name=S, class_doc=S, synopsis=S, action_phrase=S, role=S, visibility_score=D, input_datatype=S, output_datatype=S,
    semantic_methods=STRINGS, structured_docs=struct(sections=T.MapType(S, struct(methods=METHODS))),
)
USED_CLASS = T.StructType([T.StructField("class", S), T.StructField("variables", STRINGS), T.StructField("methods", STRINGS)])
CODE_CHUNK = struct(
    chunk_id=S, example_id=S, action_phrase=S, synopsis=S, role=S, visibility_score=D, input_datatype=S, output_datatype=S, content=S, variable_name=S,
    vtk_classes=T.ArrayType(USED_CLASS), vtk_class_names=STRINGS, queries=STRINGS, is_pythonic=B,
)
DOC_CHUNK = struct(
    chunk_id=S, chunk_type=S, vtk_class=S, content=S, synopsis=S, role=S, action_phrase=S, visibility_score=D, module=S, input_datatype=S, output_datatype=S, queries=STRINGS,
)
