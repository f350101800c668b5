"""Paths, diagnostics, reference counts, transactions."""

import pytest
from pareframe.functions import diagnostics
from pareframe.operators import paths, refcount
from pareframe.operators.snapshot import Aborted, Snapshot, TransactionFailed
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tree(spark):
    files = ["a/b/c/x", "a/b/c/y", "a/d", "e/f/g"]
    return paths.nodes(spark.createDataFrame([(f.split("/"),) for f in files], "parts array<string>")).cache()


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "prefix string")


def values(df, column="prefix"):
    return {r[column] for r in df.collect()}


def test_chain_ends(spark, tree):
    ends = {r.prefix: r["last"] for r in paths.chain_ends(tree).collect()}
    assert ends == {"a": "a", "a/b": "a/b/c", "a/b/c": "a/b/c", "a/b/c/x": "a/b/c/x", "a/b/c/y": "a/b/c/y", "a/d": "a/d", "e": "e/f", "e/f": "e/f", "e/f/g": "e/f/g"}
    deep = paths.nodes(spark.createDataFrame([(["a", "b", "c", "d", "e"],), (["a", "b", "c", "d", "f"],)], "parts array<string>"))
    assert {r.prefix: r["last"] for r in paths.chain_ends(deep).collect()}["a"] == "a/b/c/d"


def test_possible_roots(spark):
    tree = paths.nodes(spark.createDataFrame([(f.split("/"),) for f in ("p/src/main/x", "p/src/gen/y", "q/lib/z", "q/src/w")], "parts array<string>"))
    roots = lambda content, sources, ignored=(): values(paths.possible_roots(named(spark, *content), named(spark, *sources), tree, named(spark, *ignored), "."))
    assert roots(["p"], ["q/lib"]) == {"p/src", "q/lib"}
    assert roots(["p", "q"], ["p/src/main"], ["p/src/gen"]) == {"p/src/main", "q/src"}
    assert roots(["z"], []) == {"."}


def test_tree(spark, tree):
    assert {r.prefix: r.n for r in tree.collect()} == {"a": 3, "a/b": 2, "a/b/c": 2, "a/b/c/x": 1, "a/b/c/y": 1, "a/d": 1, "e": 1, "e/f": 1, "e/f/g": 1}
    assert values(paths.single_chains(tree)) == {"a/b", "e"}
    assert values(paths.topmost(named(spark, "a/b", "a/b/c/x", "e/f/g"))) == {"a/b", "e/f/g"}
    assert {(r.prefix, r.ancestor) for r in paths.nearest(tree, named(spark, "a", "a/b")).collect()} == {("a/b", "a"), ("a/b/c", "a/b"), ("a/b/c/x", "a/b"), ("a/b/c/y", "a/b"), ("a/d", "a")}


def test_roots(spark, tree):
    assert values(paths.propagated_roots(tree, named(spark, "a", "e"), named(spark, "a/b/c/x"))) == {"a/b/c/y", "a/d", "e"}
    assert values(paths.propagated_roots(tree, named(spark, "a"), named(spark, "zzz"))) == {"a"}
    assert values(paths.propagated_roots(tree, named(spark, "a", "e"), named(spark, "e"))) == {"a"}


def one(spark, **columns):
    df = spark.range(1)
    return df.select(*(c.alias(k) for k, c in columns.items())).first()


def test_messages(spark):
    message, stack = diagnostics.split_message(F.lit("bad\nthing\n\tat a.B\n\tat c.D"))
    kind, rest = diagnostics.split_type(F.lit("Type: text: more"))
    r = one(spark, m=message, s=stack, k=kind, t=rest, none=diagnostics.split_message(F.lit("no stack"))[1], p=diagnostics.position(F.lit("C:/x.kt:3:14")), q=diagnostics.position(F.lit("x.kt")))
    assert (r.m, r.s, r.k, r.t, r.none) == ("bad\nthing", "\tat a.B\n\tat c.D", "Type", "text: more", None)
    assert tuple(r.p) == ("C:/x.kt", 3, 14) and r.q is None


@pytest.mark.parametrize(
    "text, seen",
    [
        ("file:///base/x.kt:1:2 /base/y /other", "file://x.kt:1:2 /base/y /other"),
        ("/home/base/x.kt:1:2", "../home/base/x.kt:1:2"),
        ("/based/x.kt:-1:-1", "../based/x.kt:-1:-1"),
        ("in /base/a/b.kt:3:4 and /base/c.kt:5:6!", "in a/b.kt:3:4 and c.kt:5:6!"),
        ("no path, 1:2", "no path, 1:2"),
        ("ratio 1/2 in /base/a.kt:1:2", "ratio 1/2 in a.kt:1:2"),
        ("at / or so in /base/a.kt:1:2", "at / or so in a.kt:1:2"),
        ("http://x/y:80:1 is none", "http://x/y:80:1 is none"),
        ("(see \"/base/a.kt:1:2\"), \t'file:///base/b.kt:-1:-1'.\n /base/c:3", "(see \"a.kt:1:2\"), \t'file://b.kt:-1:-1'.\n /base/c:3"),
        ("/base/./x/../a.kt:1:2", "a.kt:1:2"),
        ("", ""),
    ],
)
def test_relative(spark, text, seen):
    assert one(spark, a=diagnostics.relative(F.lit(text), F.lit("/base"))).a == seen


def test_relative_paths(spark):
    path = lambda p, base: diagnostics.relative_path(F.lit(p), F.lit(base))
    r = one(spark, a=path("/a/b/c", "/a/x/y"), b=path("/a/b", "/a/b"), c=path("rel/x", "/a"), d=path("/x", "/"), e=path("/base/./y/../z", "/base/q/.."), f=path("/../x", "/"))
    assert tuple(r) == ("../../b/c", "", "rel/x", "x", "z", "x")


def test_stack_prefix(spark):
    lines = F.array(*map(F.lit, (" at a ", "\tat   b", "c", "at d")))
    assert one(spark, b=diagnostics.stack_prefix(lines, "at ")).b == ["a", "b"]


BACKEND, OLD_BACKEND = diagnostics.BACKEND_TYPES
ISSUE = f"{BACKEND}: Back-end: {diagnostics.INTERNAL_ENDS}"
STACK = "\n\tat a.B\n\tat c.D"


@pytest.mark.parametrize(
    "message, description, expected",
    [
        ("Unresolved reference", "e: text", ("general", "Unresolved reference", None, ("T.kt", 3, 5))),
        (ISSUE, f"{ISSUE}\nTest.kt:-1:-1\nDetails: bad{STACK}", ("backend", "Details: bad", STACK[1:], ("Test.kt", -1, -1))),
        (f"{OLD_BACKEND}: lowering", f"{OLD_BACKEND}: lowering\nFile being compiled: /a/B.kt\nThe root{STACK}\nCaused by", ("backend", "The root", STACK[1:] + "\nCaused by", ("/a/B.kt", -1, -1))),
        (f"{diagnostics.INTERNAL_STARTS[2]}: While", f"{diagnostics.INTERNAL_STARTS[2]}: While analysing T.kt:1:2: x{STACK}", ("internal", "While analysing T.kt:1:2: x", STACK[1:], None)),
        (f"x {diagnostics.INTERNAL_ENDS}", "Some.Type: no stack", ("internal", "no stack", None, None)),
        (f"[ksp] own{STACK}", None, ("ksp", "own", STACK[1:], None)),
        ("[ksp] no stack", None, None),
        (ISSUE, ISSUE, None),
        (ISSUE, f"{ISSUE}\nFile.kt:-1:-1", None),
        (ISSUE, f"{ISSUE}\nFile.kt:-1:-1\nno stack", None),
        (ISSUE, "no colon", None),
    ],
)
def test_parsing_rules(spark, message, description, expected):
    rows = spark.createDataFrame([(message, description, "e", "T.kt:3:5")], "message string, description string, letter string, place string")
    found = [(r.kind, r.text, r.stack, tuple(r["at"]) if r["at"] else None) for r in diagnostics.parsed(rows).collect()]
    assert found == ([expected] if expected else [])


def test_reported_and_relativised(spark):
    rows = spark.createDataFrame([("bad /base/x.kt:1:2", None, x, "/base/y.kt:3:4") for x in "ewix"], "message string, description string, letter string, place string")
    found = diagnostics.relativised(diagnostics.reported(diagnostics.parsed(rows)), F.lit("/base"))
    assert {(r.severity, r.text, r["at"].file) for r in found.collect()} == {(x, "bad x.kt:1:2", "y.kt") for x in ("ERROR", "UNKNOWN")}


def test_comparator(spark):
    kind = "k int, i int, kind string, text string, severity string, stack string, at struct<file:string,line:int,col:int>"
    far = "\tat org.jetbrains.kotlin.x.Y"
    lists = {
        1: ([("general", "a", "ERROR", None, ("f", 1, 2))], [("general", "a", "ERROR", None, ("g", 3, 4))], True),
        2: ([("general", "a", "ERROR", None, None)], [("general", "a", "WARNING", None, None)], False),
        3: ([("backend", "m" * 90, None, far, None)], [("backend", "m" * 90 + "n", None, far + "Z", None)], True),
        4: ([("backend", "one text", None, far, None)], [("backend", "another one", None, far, None)], False),
        5: ([("internal", "x", None, None, None)] * 2, [("internal", "x", None, None, None)], False),
        6: ([("general", "x", None, None, None)], [("internal", "x", None, None, None)], False),
        7: ([("internal", "", None, "\tat java.z", None)], [("internal", "", None, "\tat java.q\n" + far, None)], True),
        8: ([("ksp", "x", None, None, None)], [], False),
    }
    sides = [spark.createDataFrame([(k, i, *row) for k, v in lists.items() for i, row in enumerate(v[side])], kind) for side in (0, 1)]
    found = {r.k: r.same for r in diagnostics.same_failures(*sides, ["k"], ["i"]).collect()}
    assert found == {k: v[2] for k, v in lists.items()}


def test_transformers_go_in_order(spark):
    found = diagnostics.chain(spark.range(3), lambda d: d.where("id > 0"), lambda d: d.select((F.col("id") * 2).alias("x")))
    assert sorted(r.x for r in found.collect()) == [2, 4]


def test_similarity(spark):
    rows = [(1, 1, "same", "same"), (1, 2, "", ""), (2, 1, "abc", "xyz"), (3, 1, "same", "same"), (3, 2, "frame one", "frame two"), (4, 1, "x", None)]
    found = {r.k: r for r in diagnostics.similarity(spark.createDataFrame(rows, "k int, i int, a string, b string"), ["k"], "i", "a", "b").collect()}
    assert found[1].similarity == 1 and found[1].similar
    assert found[2].similarity == round(1 - 2.718281828459045**-1, 6) and not found[2].similar
    assert found[3].similarity == round(1 - 2.718281828459045**-2 / 3, 6) and found[3].similar


def test_refcounts(spark):
    uses = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    left = refcount.decrease(refcount.count(uses, "key"), uses.where("key = 'b'"), "key")
    assert [r.key for r in refcount.unused(left).collect()] == ["b"]
    assert [tuple(r) for r in refcount.purge(left).collect()] == [("a", 2)]


def test_transactions(spark):
    state = Snapshot(spark.range(10))
    assert state.transaction(lambda df: df.where("id > 4"))

    def give_up(df):
        raise Aborted

    def fail(df):
        raise ZeroDivisionError

    assert not state.transaction(give_up)
    with pytest.raises(TransactionFailed):
        state.transaction(fail)
    assert state.data.count() == 5 and state.version == 1
    assert state.log == [(1, "committed"), (1, "aborted"), (1, "failed")]
