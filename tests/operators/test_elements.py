"""Elements, imports, benchmark runs."""

import pytest
from pareframe.operators import elements, imports, search
from pareframe.operators.stages import Pipeline, Settings, benchmark
from pyspark.sql import functions as F

KIND = "file string, path array<int>, kind string, lang string, has_body boolean, is_constructor boolean, is_operator boolean, in_value_class boolean"


def test_items(spark):
    rows = [
        ("a", [1], "function", "x", True, False, False, False),
        ("a", [2], "function", "x", None, None, None, None),
        ("a", [3], "function", "x", False, False, False, False),
        ("a", [4], "method", "java", True, True, False, False),
        (None, [5], "method", "java", True, False, False, False),
        ("b", [6], "class", "x", True, False, False, False),
        ("b", [7], "parameter", "x", None, None, True, None),
        ("b", [8], "parameter", "x", None, None, None, True),
        ("b", [9], "parameter", "x", None, None, None, None),
    ]
    table = spark.createDataFrame(rows, KIND)
    at = lambda df: sorted(r.path[0] for r in df.collect())
    assert at(elements.body_items([table.where("lang = 'x'"), table.where("lang = 'java'")])) == [1, 2]
    others, parameters = table.where("kind <> 'parameter'"), table.where("kind = 'parameter'")
    assert at(elements.deletable_items(others)) == [1, 2, 3, 6]
    assert at(elements.deletable_items(others, parameters)) == [1, 2, 3, 6, 9]
    items = spark.createDataFrame([("a", [1]), ("a", [99])], "file string, path array<int>")
    assert [r.kind for r in elements.resolved(items, table).collect()] == ["function"]
    with pytest.raises(ValueError, match="one file"):
        elements.one_file(table.where("file IS NOT NULL"))
    assert elements.one_file(items).count() == 2


def test_traces_and_parameters(spark):
    callables = spark.createDataFrame([("f",), ("g",)], "callable string")
    usages = spark.createDataFrame([("f", "y", None), ("f", "x", False), ("f", "x", False), ("f", "z", True), ("f", None, False), ("h", "x", False)], "callable string, place string, in_import boolean")
    assert {r.callable: r.traces for r in elements.call_traces(callables, usages).collect()} == {"f": ["x", "y"], "g": []}
    sides = [spark.createDataFrame([("f", i, f"{side}{i}") for i in range(n)], "function string, ordinal int, name string") for side, n in (("e", 3), ("a", 2))]
    assert sorted((r.ordinal, r.expected, r.actual) for r in elements.matching_parameters(*sides).collect()) == [(0, "e0", "a0"), (1, "e1", "a1")]


def test_paths_tasks_and_progress(spark):
    mixed = spark.createDataFrame([(["A", "f", "3", "B"],), (["A"],), (["1"],)], "path array<string>").select(elements.mixed_path(F.col("path"), F.transform("path", lambda x: ~x.rlike("[0-9]"))).alias("m"))
    assert [(r.m.stubs, r.m.children) for r in mixed.collect()] == [(["A", "f"], ["3", "B"]), (["A"], []), ([], ["1"])]
    files = spark.createDataFrame([(".idea/x",), (".ideal/x",), ("logs",), ("a/logs",)], "path string")
    assert sorted(r.path for r in elements.copied(files, (".idea", "logs")).collect()) == [".ideal/x", "a/logs"]
    tasks = spark.createDataFrame([(":app:build",), (":build",), (":lib:prebuild",)], "path string")
    find = lambda name: sorted(r.path for r in elements.tasks_named(tasks, F.lit(name)).collect())
    assert find(":build") == [":build"] and find("build") == [":app:build", ":build"]
    steps = [elements.progress(200, left) for left in (200, 199, 100, 0)]
    assert steps == [1, 1, 50, 100] and elements.progress(10, 10, before=40) == 40 and elements.progress(0, 0) == 100


def test_imports(spark):
    given = [("f", "p.A", None, False), ("f", "p.B", "X", False), ("f", "q", None, True), ("f", "own.C", None, False), ("f", "z.Lost", None, False), ("f", "z.Never", None, False), ("f", "root", None, True)]
    uses = [("f", "p.A", "A"), ("f", "p.A", "A"), ("f", "p.B", "X"), ("f", "q.D", "D"), ("f", "q.E", "E"), ("f", "own.C", "C"), ("f", "Top", "Top")]
    table = spark.createDataFrame(given, "file string, path string, alias string, star boolean")
    kinds = ("file string, path string, name string", "file string, name string", "file string, package string")
    parts = [spark.createDataFrame(rows, kind) for rows, kind in zip((uses, [("f", "Lost"), ("f", "Lost")], [("f", "own")]), kinds, strict=True)]
    used = imports.used_imports(table, *parts)
    assert {r.path: r.n for r in used.collect()} == {"p.A": 2, "p.B": 1, "q": 2, "z.Lost": 2}
    assert {r.path for r in imports.unused_imports(table, used).collect()} == {"own.C", "z.Never", "root"}
    renamed = imports.needing_import(spark.createDataFrame([("f", "own.C", "Y")], kinds[0]), parts[2])
    assert [r.path for r in renamed.collect()] == ["own.C"]


def test_benchmark(spark):
    projects = spark.createDataFrame([("one",), ("two",), ("no",)], "name string")
    data = {"one": spark.range(8), "two": spark.range(4, 8)}

    def fails_with_five(rows, settings):
        items = search.numbered(rows, "id")
        test = search.same_failure(items, lambda x: "five" if x.where("id = 5").count() else None, settings.similar)
        return search.retained(items, settings.find(test)).where("retained").select("id")

    report = benchmark(projects, lambda p: p.where("name <> 'no'"), data.__getitem__, Pipeline({"flat": fails_with_five}), Settings(stages=("flat",)))
    assert sorted(tuple(r) for r in report.collect()) == [("one", 8, 1, 1 / 8), ("two", 4, 1, 1 / 4)]
    none = benchmark(projects.where("name = 'one'"), lambda p: p, lambda name: spark.range(3), Pipeline({"flat": fails_with_five}), Settings(stages=("flat",)))
    assert [(r.before, r.after, r.ratio) for r in none.collect()] == [(3, None, None)]
    assert Settings().stages == ("function", "graph", "file")
