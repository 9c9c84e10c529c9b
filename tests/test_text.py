"""Column functions on names, texts and questions."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import questions, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("phrase", "question"),
    [
        ("isosurface generation", "How do you generate an isosurface?"), ("data reading", "How do you read data?"), ("rendering", "How do you render?"),
        ("sphere", "How do you use sphere?"), ("the plane cutting", "How do you cut the plane?"), ("", None), (None, None),
    ],
)
def test_class_questions(spark, phrase, question):
    assert one(spark, questions.class_to_question(F.lit(phrase).cast("string"))) == question


@pytest.mark.parametrize(
    ("method", "phrase", "question"),
    [
        ("SetRadius", "sphere", "How do you set the radius of a sphere?"), ("AddRenderer", "render window", "How do you add a renderer to a render window?"),
        ("VisibilityOn", "actor", "How do you enable visibility on an actor?"), ("GetOutput", "sphere", None), ("Update", "sphere", None), ("Add", "data", "How do you add data?"),
    ],
)
def test_method_questions(spark, method, phrase, question):
    assert one(spark, questions.method_to_question(F.lit(method), F.lit(phrase))) == question


@pytest.mark.parametrize(("name", "question"), [("make_hexahedron", "how to make a hexahedron"), ("makeArrow", "how to make an arrow"), ("helper", "how to use helper"), ("my_helper", "how to use my helper"), ("__", "how to use __")])
def test_function_questions(spark, name, question):
    assert one(spark, questions.function_to_question(F.lit(name))) == question


@pytest.mark.parametrize(
    ("method", "args", "phrase"),
    [("SetRadius", ["2.5"], "radius set to 2.5"), ("SetCenter", ["1", "2"], "center set to (1, 2)"), ("AddActor", ["a"], "actor added"), ("ShadingOff", [], "shading disabled"), ("Orient", ["x"], "orient with x"), ("Orient", [], None), ("Render", [], None)],
)
def test_call_phrases(spark, method, args, phrase):
    assert one(spark, questions.call_to_phrase(F.lit(method), F.lit(args).cast("array<string>") if args else F.array().cast("array<string>"))) == phrase


def test_names(spark):
    assert one(spark, text.camel_to_words(F.lit("LUTSize"))) == "l u t size"
    assert one(spark, text.class_to_var(F.lit("vtkmDataSet"))) == "dataSet"
    assert one(spark, text.attr_to_setter(F.lit("phiResolution"))) == "SetPhiresolution"
    assert one(spark, text.path_segment(F.lit("https://h/Python/Demo/"))) == "Demo"
    assert one(spark, text.path_segment(F.lit("plain"))) == "plain"
    assert one(spark, text.fallback_phrase(F.lit("vtkEventDataDevice"))) == "Event data device"
    assert one(spark, text.with_article(F.lit(""))) == ""
    assert one(spark, text.preview(F.lit("abcdef"), 3)) == "abc..."


def test_dedupe_keeps_first_spelling(spark):
    assert one(spark, text.dedupe_ci(F.array(*map(F.lit, ["A", "b", "a", "B", "c"]), F.lit(None)))) == ["A", "b", "c"]
    assert one(spark, text.dedupe_ci(F.array().cast("array<string>"))) == []


def test_dedupe_sorts_distinct_spellings_only(spark):
    same = text.dedupe_ci(F.concat(F.array(F.lit("b"), F.lit("A"), F.lit("B"), F.lit("a")), F.array_repeat(F.lit("b"), 300)))
    assert one(spark, same) == ["b", "A"]
    assert "array_distinct" in str(same)


@pytest.mark.parametrize(("word", "capital"), [("ßein", "ẞein"), ("ŉa", "ŉa"), ("ﬁx", "ﬁx"), ("ᾀx", "ᾈx"), ("ǆx", "Ǆx"), ("éa", "Éa"), ("über", "Über"), ("", ""), (None, None)])
def test_a_capital_is_one_letter(spark, word, capital):
    assert one(spark, text.capitalize_first(F.lit(word).cast("string"))) == capital
