"""Static analysis and chunk assembly, on own snippets."""

import pytest

from corvane.operators import api_dim, code_chunks, doc_chunks
from corvane.operators.code_analysis import files, lifecycles
from corvane.plans.queries import CLASS_SCHEMA, CLASSES, SNIPPETS
from corvane.schemas import CODE_CHUNK, DOC_CHUNK, RAW_DOC
from corvane.sources import jsonl

ROLES = {
    "vtkSphereSource": "input", "vtkPolyDataMapper": "properties", "vtkActor": "properties", "vtkProperty": "properties", "vtkRenderer": "renderer", "vtkCamera": "scene",
    "vtkRenderWindow": "infrastructure", "vtkRenderWindowInteractor": "infrastructure", "vtkInteractorStyleTrackball": "infrastructure", "vtkMath": None, "vtkVolume": "properties",
}


def groups(code):
    return [[(m.variable, m.cls) for m in g] for _, g in files.analyse(code, ROLES)]


def member(code, variable):
    return next(m for _, g in files.analyse(code, ROLES) for m in g if m.variable == variable)


def test_worked_trace():
    found = list(files.analyse(SNIPPETS[0][1], ROLES))
    assert [[m.variable for m in g] for _, g in found] == [["m", "a"], ["s"]]
    a = found[0][1][1]
    assert (a.mapper, a.properties, a.methods, len(a.statements)) == ("m", [("inline", "vtkProperty")], ["SetMapper"], 3)
    assert found[1][1][0].methods == ["SetRadius", "SetThetaResolution"]


@pytest.mark.parametrize("line", ["s.radius = 1.0", "s.SetRadius(1.0)"])
def test_methods_and_attributes_are_setters(line):
    m = member(f"s = vtk.vtkSphereSource()\n{line}\n", "s")
    assert m.methods == ["SetRadius"]
    assert m.calls == [("SetRadius", ["1.0"])]


def test_infrastructure_is_one_group_that_ends_with_start():
    code = "st = vtkInteractorStyleTrackball()\nit = vtkRenderWindowInteractor()\nit.Initialize()\nit.Start()\nw = vtkRenderWindow()\nc = vtkCamera()\nr = vtkRenderer()\n"
    found = groups(code)
    assert [v for v, _ in found[0]] == ["w", "it", "st", "it"]
    assert found[1:] == [[("c", "vtkCamera")], [("r", "vtkRenderer")]]
    parts = [m for _, g in files.analyse(code, ROLES) for m in g if m.variable == "it"]
    assert [m.methods for m in parts] == [["Initialize"], ["Start"]]


def test_loops():
    whole = member("r = vtkRenderer()\nfor a in xs:\n    r.AddActor(a)\n", "r")
    assert len(whole.statements) == 2
    assert whole.methods == []
    split = member("r = vtkRenderer()\ns = vtkSphereSource()\nfor a in xs:\n    r.AddActor(a)\n    s.Update()\n", "r")
    assert split.methods == ["AddActor"]


def test_properties_go_to_their_parent():
    code = "p = vtkProperty()\na = vtkActor()\na.SetProperty(p)\np.SetColor(1, 0, 0)\n"
    assert groups(code) == [[("a", "vtkActor")]]
    assert member(code, "a").properties == [("p", "vtkProperty")]
    assert len(member(code, "a").statements) == 4


def test_mapper_of_two_actors_and_orphans():
    code = "m = vtkPolyDataMapper()\na = vtkActor()\nb = vtkActor(mapper=m)\na.SetMapper(m)\no = vtkPolyDataMapper()\n"
    assert groups(code) == [[("m", "vtkPolyDataMapper"), ("a", "vtkActor")], [("m", "vtkPolyDataMapper"), ("b", "vtkActor")], [("o", "vtkPolyDataMapper")]]


def test_class_methods_are_merged():
    code = "class A:\n    def __init__(self):\n        self.m = vtkPolyDataMapper()\n    def go(self):\n        self.m.Update()\n"
    (found,) = [g for _, g in files.analyse(code, ROLES)]
    assert [(m.variable, m.methods, len(m.statements)) for m in found] == [("self.m", ["Update"], 2)]


def test_static_calls_and_helpers():
    found = list(files.analyse("def make_it():\n    x = vtkMath.Random(1)\ndef main():\n    vtkMath.Seed()\n", ROLES))
    assert [(h, g[0].variable, g[0].calls) for h, g in found] == [("make_it", None, [("Random", ["1"])]), (None, None, [("Seed", [])])]


def test_bad_source_is_a_row_with_an_error():
    (row,) = files.rows("x", "def (", ROLES)
    assert row["error"].startswith("SyntaxError")


def test_dedupe():
    assert lifecycles.distinct([1, 2, 3, 2, 1, 4]) == [1, 2, 3, 4]
    assert lifecycles.distinct_calls([("a", ["1"]), ("b", []), ("a", ["2"])]) == [("a", ["1"]), ("b", [])]


def test_code_chunks(spark):
    classes = spark.createDataFrame(CLASSES, CLASS_SCHEMA)
    chunks = code_chunks.chunk_code(spark.createDataFrame(SNIPPETS, "example_id string, code string"), classes)
    assert chunks.columns == [*CODE_CHUNK.fieldNames(), "chunk_no"]
    rows = {(r["example_id"], r["chunk_no"]): r for r in chunks.collect()}
    assert len(rows) == 5
    first, second = rows[SNIPPETS[0][0], 1], rows[SNIPPETS[0][0], 2]
    assert (first["role"], first["variable_name"], first["output_datatype"], first["is_pythonic"]) == ("properties", "m, a", "vtkActor", True)
    assert first["vtk_class_names"] == ["vtkPolyDataMapper", "vtkActor", "vtkProperty"]
    assert second["synopsis"] == "Polygonal sphere creation with radius set to 2.0, theta resolution set to 8"
    assert second["queries"] == ["How do you create a polygonal sphere?", "How do you set the radius of a polygonal sphere creation?", "How do you set the theta resolution of a polygonal sphere creation?"]
    window = rows[SNIPPETS[1][0], 1]
    assert window["content"].startswith("import vtkmodules.vtkRenderingOpenGL2\nimport vtkmodules.vtkInteractionStyle\nfrom mod.Core import vtkRenderWindow, vtkRenderWindowInteractor\n\nwin = vtkRenderWindow()")
    assert window["queries"][-1] == "how to make a window"


def test_doc_chunks(spark):
    sections = {"Methods defined here:": {"methods": {"SetX": "SetX(x) -> None\nSets the x.", "Skip": "Skip()"}}, "Methods inherited": {"methods": {"SetY": "no"}}}
    raw = [("vtkFoo", "mod", "Foo doc.\nSuperclass: vtkBar", "a foo", "foo generation", "filter", 0.5, "", "", ["SetX"], {"sections": sections}), ("vtkBar", "mod2", *[None] * 9), (None, "mod3", *[None] * 9)]
    docs = jsonl.with_doc_defaults(spark.createDataFrame(raw, RAW_DOC))
    chunks = doc_chunks.chunk_docs(docs)
    assert chunks.columns == [*DOC_CHUNK.fieldNames(), "pos"]
    rows = {r["chunk_id"]: r for r in chunks.collect()}
    assert sorted(rows) == ["vtkBar_constructor", "vtkFoo_SetX", "vtkFoo_constructor", "vtkFoo_inheritance", "vtkFoo_overview"]
    assert rows["vtkFoo_SetX"]["synopsis"] == "vtkFoo.SetX() - Sets the x."
    assert rows["vtkFoo_inheritance"]["content"].endswith("**Superclass Module:** `mod2`")
    assert rows["vtkFoo_overview"]["queries"][0] == "How do you generate a foo?"
    assert {r["chunk_type"]: r["n"] for r in doc_chunks.count_by_type(chunks).collect()} == {"class_overview": 1, "constructor": 2, "inheritance": 1, "method": 1}
    classes = api_dim.api_classes(docs)
    assert [r["class"] for r in api_dim.search_classes(classes, "FOO").collect()] == ["vtkFoo"]
    assert {r["method"] for r in api_dim.method_info(api_dim.api_methods(docs), "vtkFoo").collect()} == {"SetX", "Skip", "SetY"}


def test_classes_beyond_the_broadcast(spark, monkeypatch):
    classes = spark.createDataFrame(CLASSES, CLASS_SCHEMA)
    code = spark.createDataFrame([*SNIPPETS, SNIPPETS[0]], "example_id string, code string")
    key = lambda df: sorted(map(str, df.collect()))
    sent = key(code_chunks.lifecycles(code, classes))
    monkeypatch.setattr(api_dim, "MOST_CLASSES", 2)
    assert key(code_chunks.lifecycles(code, classes)) == sent


def test_files_are_analysed_once(spark):
    chunks = code_chunks.chunk_code(spark.createDataFrame(SNIPPETS, "example_id string, code string"), spark.createDataFrame(CLASSES, CLASS_SCHEMA))
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_dimension_accessors(spark):
    raw = [("vtkFoo", "mod", "Foo doc.", "a foo", "", "filter", 0.5, "", "", ["SetX"], {"sections": {"Methods defined here:": {"methods": {"SetX": "SetX(x) -> None\nSets.", "A": "A()"}}}})]
    docs = jsonl.with_doc_defaults(spark.createDataFrame(raw, RAW_DOC))
    classes, methods = api_dim.api_classes(docs), api_dim.api_methods(docs)
    assert api_dim.class_doc(classes, "vtkFoo").collect() == [("Foo doc.",)]
    assert api_dim.class_synopsis(classes, "vtkFoo").collect() == [("a foo",)]
    assert api_dim.class_methods(methods, "vtkFoo").collect() == [("A",), ("SetX",)]
    assert api_dim.method_signature(methods, "vtkFoo", "SetX").collect() == [("SetX(x) -> None",)]
    assert api_dim.method_doc(methods, "vtkFoo", "A").collect() == [("A()",)]


def large_script():
    """About nine hundred lines: pipelines with an actor each, 2D ones, a loop, text, windows and an interactor."""
    lines = ["import vtk", "def main():"]
    for i in range(20):
        lines += [f"    source{i} = vtkSphereSource()", f"    source{i}.SetCenter({i}, 0, 0)", f"    source{i}.SetRadius({i}.5)"]
        lines += [f"    source{i}.SetThetaResolution({k})" for k in range(8)]
        lines += [f"    mapper{i} = vtkPolyDataMapper()", f"    mapper{i}.SetInputConnection(source{i}.GetOutputPort())", f"    actor{i} = vtkActor()", f"    actor{i}.SetMapper(mapper{i})"]
        lines += [f"    actor{i}.GetProperty().SetOpacity(0.{k + 1})" for k in range(9)]
    for i in range(6):
        lines += [f"    flat{i} = vtkPolyDataMapper2D()", f"    actor2d{i} = vtkActor2D()", f"    actor2d{i}.SetMapper(flat{i})", f"    text{i} = vtkTextProperty()", f"    text{i}.SetFontSize({i})", f"    actor2d{i}.SetTextProperty(text{i})"]
    lines += ["    ren = vtkRenderer()", "    win = vtkRenderWindow()", "    win.AddRenderer(ren)", "    for a in actors:", "        ren.AddActor(a)", "        ren.ResetCamera()", "    it = vtkRenderWindowInteractor()", "    it.SetRenderWindow(win)"]
    lines += [f"    ren.SetBackground({i}, 0, 0)" for i in range(400)] + ["    it.Initialize()", "    win.Render()", "    it.Start()", "main()"]
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def large(spark):
    roles = [(c, "mod.X", r, 0.5, "", "", "", "") for c, r in (ROLES | {"vtkPolyDataMapper2D": "properties", "vtkActor2D": "properties", "vtkTextProperty": "properties"}).items()]
    chunks = code_chunks.chunk_code(spark.createDataFrame([("large", large_script())], "example_id string, code string"), spark.createDataFrame(roles, CLASS_SCHEMA))
    return sorted(chunks.collect(), key=lambda r: r["chunk_no"])


def test_large_script_chunks(large):
    assert large_script().count("\n") > 850
    assert len(large) == 1 + 20 + 6 + 20 + 1  # infrastructure, actors, 2D actors, sources, renderer
    sizes = [len(r["content"]) for r in large]
    assert sum(n < 50 for n in sizes) < 0.3 * len(sizes)
    assert sum(n > 4000 for n in sizes) < 3
    assert len({(r["chunk_id"], r["chunk_no"]) for r in large}) == len(large)
    assert all(r["queries"] and r["synopsis"] and r["content"] and r["role"] for r in large)


def test_large_script_groups(large):
    by = {}
    for r in large:
        by.setdefault(r["variable_name"], []).append(r)
    assert "mapper3, actor3" in by and "flat2, actor2d2" in by  # mappers stand with their actors, 2D ones too
    assert by["flat2, actor2d2"][0]["vtk_class_names"] == ["vtkPolyDataMapper2D", "vtkActor2D", "vtkTextProperty"]
    assert "text2.SetFontSize(2)" in by["flat2, actor2d2"][0]["content"]
    infra = large[0]
    assert infra["role"] == "infrastructure"
    assert infra["content"].rstrip().endswith("it.Start()")
    assert "ren.AddActor" not in infra["content"]  # the loop's body is the renderer's
    (renderer,) = by["ren"]
    assert "for a in actors:" in renderer["content"] and "ren.ResetCamera()" in renderer["content"]
    assert len(renderer["queries"]) == len(set(q.lower() for q in renderer["queries"]))
    assert by["source4"][0]["content"].count("source4.SetThetaResolution") == 8
    assert by["source4"][0]["synopsis"].count("theta resolution") == 1  # of repeated calls the first
    assert "mapper3.SetInputConnection(source3.GetOutputPort())" in by["mapper3, actor3"][0]["content"]
    assert all("vtk.vtk" not in r["content"] and "self." not in r["content"] for r in large)


def test_statements_have_their_source():
    code = "a = vtkActor()\r\nä = 'é'; a.SetMapper('ü')\rif a:\n    a.Go(1,\x0c\r\n      '§'\n)\n"
    lines = files.re.split(rb"(?<=\n)|(?<=\r)(?!\n)", code.encode())
    found = [s for s in files.ast.walk(files.ast.parse(code)) if isinstance(s, files.ast.stmt)]
    assert [files.segment(lines, s) for s in found] == [files.ast.get_source_segment(code, s) for s in found] and len(found) == 5


def test_files_of_one_partition_are_dealt_over_tasks(spark, monkeypatch):
    code = spark.createDataFrame([(f"e{i}", SNIPPETS[0][1]) for i in range(40)], "example_id string, code string").coalesce(1)
    classes = spark.createDataFrame(CLASSES, CLASS_SCHEMA)
    monkeypatch.setattr(code_chunks, "FILES", 7)
    few = code_chunks.lifecycle_groups(code, classes)
    monkeypatch.setattr(api_dim, "MOST_CLASSES", 2)
    many = code_chunks.lifecycle_groups(code, classes)
    for groups in (few, many):
        assert groups.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
        assert sorted((r["example_id"], r["chunk_no"]) for r in groups.collect()) == sorted((f"e{i}", n) for i in range(40) for n in (1, 2))
