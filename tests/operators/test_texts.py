"""Edit scripts, argument lists, comments and kept counts."""

import random
import re
import time
from collections import Counter

import pytest
from pareframe.operators import arguments, comments, edits, refcount
from pyspark.sql import functions as F


def test_nested_touching_and_overlapping_edits():
    apply = lambda *script: edits.edited("0123456789", [(a, b, new, False) for a, b, new in script])[0]
    assert apply((2, 8, ""), (3, 5, "x")) == "0189"
    assert apply((2, 4, "a"), (4, 6, "b")) == "01ab6789"
    assert apply((2, 5, "a"), (4, 7, "b")) == "01ab789"
    assert apply((2, 5, "a"), (2, 5, "b"), (2, 5, "")) == "01b56789"
    assert apply((3, 3, "in")) == "012in3456789"
    assert apply((-5, 2, "<"), (8, 99, ">"), (50, 60, "!"), (7, 4, "no")) == "<234567>"
    assert apply() == "0123456789"


@pytest.mark.parametrize("seed", range(40))
def test_deletions_against_marked_characters(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice("abcdé😀") for _ in range(30))
    script = [(a, a + rnd.randint(0, 9), "", False) for a in (rnd.randrange(30) for _ in range(rnd.randint(0, 9)))]
    gone = {i for a, b, _, _ in script for i in range(a, b)}
    new, _, pieces = edits.edited(text, script)
    assert new == "".join(c for i, c in enumerate(text) if i not in gone)
    assert [text[p["old"] : p["old"] + p["size"]] for p in pieces] == [new[p["new"] : p["new"] + p["size"]] for p in pieces]
    assert sum(p["size"] for p in pieces) == len(new)


@pytest.mark.parametrize("seed", range(40))
def test_disjoint_replacements_against_slices(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice("xyz ") for _ in range(40))
    cuts = sorted(rnd.sample(range(41), 8))
    script = [(a, b, rnd.choice(["", "NEW", "é"]), False) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    expected = text
    for a, b, new, _ in reversed(script):
        expected = expected[:a] + new + expected[b:]
    rnd.shuffle(script)
    assert edits.edited(text, script)[0] == expected


def test_commas():
    call = "f(a,  b , c)"
    at = {x: call.index(x, 2) for x in "abc"}
    gone = lambda names: edits.edited(call, [(at[x], at[x] + 1, "", True) for x in names])[0]
    assert [gone(x) for x in ("a", "b", "c", "ab", "bc", "ac", "abc")] == ["f(b , c)", "f(a,  c)", "f(a,  b )", "f(c)", "f(a)", "f(b )", "f()"]


def test_tables_of_edits(spark):
    texts = spark.createDataFrame([(1, "hello", "a"), (2, None, "b"), (3, "", "c"), (4, "stays", None)], "id long, text string, edited2 string")
    script = spark.createDataFrame([(1, 1, 3, None, None), (1, None, 3, "x", None), (2, 0, 1, "x", False), (3, 0, 0, "new", False), (9, 0, 1, "x", False)], f"id long, {edits.EDIT}")
    found = {r.id: (r.edited, r.n_edits) for r in edits.applied(texts, script).collect()}
    assert found == {1: ("hlo", 1), 2: (None, 0), 3: ("new", 1), 4: ("stays", 0)}
    empty = edits.applied(texts.limit(0), script)
    assert empty.isEmpty() and empty.columns == ["id", "text", "edited2", "edited", "n_edits", "pieces"]


def test_old_places_in_the_new_text(spark):
    texts = spark.createDataFrame([(1, "0123456789")], "id long, text string")
    script = spark.createDataFrame([(1, 2, 4, "abc", False), (1, 8, 10, None, False)], f"id long, {edits.EDIT}")
    row = edits.applied(texts, script).select("edited", *(edits.moved(F.col("pieces"), F.lit(i).cast("long")).alias(f"m{i}") for i in range(11))).first()
    assert row.edited == "01abc4567"
    assert [row[f"m{i}"] for i in range(11)] == [0, 1, 5, 5, 5, 6, 7, 8, 9, 9, 9]


NAMES = ["x", "y", "lambda"]


@pytest.mark.parametrize(
    "call,parameters,expected",
    [
        ("f(1, 2) { it }", NAMES, NAMES), ("h(a, g(1, 2), [3, 4])", ["a", "b", "c"], ["a", "b", "c"]),
        ("A(1, \"),\")", ["x", "y"], ["x", "y"]), ("B(y = 1, z = ',', f = { a, b -> a })", ["x", "y", "z", "f"], ["y", "z", "f"]),
        ("f(y = 2, x = 1) { }", NAMES, ["y", "x", "lambda"]), ("f(lambda = { it }, y = 2, x = 1)", NAMES, ["lambda", "y", "x"]),
        ("f()", NAMES, []), ("f { it }", NAMES, ["lambda"]), ("f(1)", NAMES, ["x"]), ("f(1, 2)", NAMES, ["x", "y"]),
        ("f(x = 1, 2)", NAMES, ["x", "y"]), ("f(a == b, 2, 3, 4)", NAMES, [*NAMES, None]), ("f(\"\"\"a \" , \"\"\", `y` = 1)", NAMES, ["x", "y"]),
        ("f(\"un, finished", NAMES, []), ("f(1,)", NAMES, ["x"]), ("", NAMES, []), ("f(1)", [], [None]),
    ],
)
def test_which_parameter(call, parameters, expected):
    found = arguments.assigned(call, parameters)
    assert [a["parameter"] for a in found] == expected
    for a in found:
        assert call[a["start"] : a["end"]] == call[a["start"] : a["end"]].strip() != ""


def test_calls_without_a_parameter(spark):
    rows = [(1, "f(1, 2) { it }", NAMES), (2, "f(y = g(1, 2), x = 1)", NAMES), (3, "f(1)", NAMES), (4, None, None), (5, "f(1, 2, { })", NAMES)]
    calls = arguments.matched(spark.createDataFrame(rows, "id long, call string, parameters array<string>"))
    dropped = spark.createDataFrame([(1, "lambda"), (1, "y"), (2, "y"), (3, "y"), (4, "y"), (5, "lambda"), (5, "y"), (5, "x"), (5, "x")], "id long, parameter string")
    found = {r.id: (r.edited, r.arguments and [a.parameter for a in r.arguments]) for r in arguments.without_parameter(calls, dropped).collect()}
    assert found == {1: ("f(1) ", ["x"]), 2: ("f(x = 1)", ["x"]), 3: ("f(1)", ["x"]), 4: (None, None), 5: ("f()", [])}


def test_comments():
    text = 'a /* 1 /* 2 */ 3 */ b // c /* d\n"/* e */" \'"\' /** f */ g """ // " h""" /**/ "x\\"//" i /* end'
    cut = lambda kinds: "".join(c for i, c in enumerate(text) if not any(a <= i < b and kind in kinds for a, b, kind in comments.comments(text)))
    assert cut(comments.KINDS) == 'a  b \n"/* e */" \'"\'  g """ // " h"""  "x\\"//" i '
    assert cut(("doc",)) == text.replace("/** f */", "")
    assert [kind for _, _, kind in comments.comments(text)] == ["block", "line", "doc", "block", "block"]
    assert comments.comments("") == comments.comments("no / * comment") == []
    assert comments.comments('"open\n// then') == [(6, 13, "line")]


@pytest.mark.parametrize("seed", range(30))
def test_comments_by_a_plain_machine(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["/*", "*/", "//", "/**", "\n", "a", " ", "*", "/"]) for _ in range(60))
    at, depth, start, line, out = 0, 0, 0, False, []
    while at < len(text):
        two = text[at : at + 2]
        if line:
            line = text[at] != "\n"
            if not line:
                out.append((start, at))
            at += 1
        elif depth:
            depth += (two == "/*") - (two == "*/")
            at += 2 if two in ("/*", "*/") else 1
            if not depth:
                out.append((start, at))
        elif two in ("/*", "//"):
            start, line, depth = at, two == "//", int(two == "/*")
            at += 2
        else:
            at += 1
    if line or depth:
        out.append((start, len(text)))
    assert [(a, b) for a, b, _ in comments.comments(text)] == out


def test_comments_of_a_long_text(spark):
    unit = 'val s = "/* no */" /* a /* nested */ b */ // end\n'
    text = unit * (10_000_000 // len(unit))
    texts = spark.createDataFrame([(1, text), (2, None), (3, "/*" * 500_000)], "id long, text string")
    begun = time.perf_counter()
    found = {r.id: r.edited for r in comments.without(texts).select("id", "edited").collect()}
    assert found == {1: re.sub(r" /\* a.* // end", "  ", text), 2: None, 3: ""}
    assert time.perf_counter() - begun < 60


def test_counts_are_kept_up(spark, tmp_path):
    rnd = random.Random(3)
    uses = [(f"f{rnd.randrange(12)}", f"k{rnd.randrange(5)}") for _ in range(200)]
    counts = refcount.Counts(spark, f"{tmp_path}/counts", 8)
    counts.create(spark.createDataFrame(uses, "file string, key string"))
    expected = Counter(uses)
    read = lambda: {(r.file, r.key): r.n for r in counts.read().collect()}
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("counts/bucket=*/*.parquet")}
    assert read() == expected
    deltas = [("f1", "k0", 2), ("f1", "k0", 1), ("f2", "k1", -1000), ("new", "k9", 1)]
    before = files()
    touched = counts.change(spark.createDataFrame(deltas, "file string, key string, change long"), spark.createDataFrame([("f3",), ("none",)], "file string"))
    same = {p for p in before if int(p.parent.name.split("=")[1]) not in touched}
    assert 0 < len(touched) < 8 and same and all(files().get(p) == before[p] for p in same)
    expected[("f1", "k0")] += 3
    expected[("new", "k9")] = 1
    expected = {k: n for k, n in expected.items() if k != ("f2", "k1") and k[0] != "f3"}
    assert read() == expected
    none = spark.createDataFrame([], "file string, key string, change long")
    assert counts.change(none) == [] and read() == expected
    # a bucket that loses all of its rows
    counts.change(none, spark.createDataFrame([(f,) for f, _ in expected], "file string"))
    assert read() == {}
