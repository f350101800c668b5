"""The multigraph of declarations, and records of files that are read in splits."""

import random
import re

import pytest
from pareframe.operators import members
from pareframe.sources import files
from pyspark.sql import functions as F


def edges_of(spark, elements, types, declared, usages):
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    found = members.multigraph(
        table(elements, "id string, path string, parent string"), table(types, "sub string, super string"),
        table(declared, "id string, owner string, name string, abstract boolean"), table(usages, "src string, dst string"),
    )
    return sorted(map(tuple, found.collect()))


def test_simple(spark):
    """A class below another, with a function and a property that a second function uses."""
    ids = ["A", "B", "f", "x", "g"]
    elements = [(i, "simple.kt", "B" if i in "fxg" else None) for i in ids]
    found = edges_of(spark, elements, [("B", "A")], [(i, "B", i, False) for i in "fxg"], [("B", "A"), ("g", "f"), ("g", "x")])
    assert len(found) == 13
    expected = [("B", "A", "overload"), ("B", "A", "usage"), ("g", "f", "usage"), ("g", "x", "usage"), ("simple.kt", "", "file")]
    expected += [(i, "B", "tree") for i in "fxg"] + [(i, "simple.kt", "tree") for i in ids]
    assert found == sorted(expected)


def test_overrides_hide_those_above(spark):
    """D overrides f of A and C, of which it inherits both; E overrides D's, and nothing above it."""
    types = [("D", "A"), ("D", "B"), ("D", "C"), ("E", "D")]
    declared = [("A.f", "A", "f", False), ("C.f", "C", "f", False), ("D.f", "D", "f", False), ("E.f", "E", "f", False)]
    elements = [(i, "o.kt", None) for i in "ABCDE"] + [(i, "o.kt", owner) for i, owner, _, _ in declared]
    uses = [("D", "A"), ("D", "B"), ("D", "C"), ("E", "D"), ("g", "D"), ("g", "D")]
    found = edges_of(spark, elements, types, declared, uses)
    kinds = lambda kind: [(a, b) for a, b, k in found if k == kind]
    assert kinds("overload") == sorted([*types, ("D.f", "A.f"), ("D.f", "C.f"), ("E.f", "D.f")])
    assert kinds("obligatory") == [("D", "D.f")]
    assert kinds("usage").count(("g", "D")) == 2


def test_chains_of_names(spark):
    """Type names that stand for each other have uses only."""
    uses = [("A", "I"), ("B", "A"), ("C", "A"), ("C", "I"), ("D", "B"), ("D", "C")]
    found = edges_of(spark, [(i, "src/a/alias.kt", None) for i in "IABCD"], [], [], uses)
    assert len(found) == 6 + 5 + 3
    assert [e for e in found if e[2] == "file"] == [("src", "", "file"), ("src/a", "src", "file"), ("src/a/alias.kt", "src/a", "file")]


@pytest.mark.parametrize("seed", range(4))
def test_overridden_against_a_plain_search(spark, seed):
    rnd = random.Random(seed)
    n = 14
    types = {(i, rnd.randrange(i)) for i in range(1, n) for _ in range(2)} | ({(3, 9), (5, 5)} if seed % 2 else set())
    declared = [(f"{i}.{k}", i, k, False) for i in range(n) for k in "fg" if rnd.random() < 0.4]
    own = {(i, k): m for m, i, k, _ in declared}
    expected = set()
    for m, i, k, _ in declared:
        seen, todo = set(), [b for a, b in types if a == i and b != i]
        while todo:
            t = todo.pop()
            if t in seen:
                continue
            seen.add(t)
            if (t, k) in own:
                expected |= {(m, own[t, k])} - {(m, m)}
            else:
                todo += [b for a, b in types if a == t and b != t]
    found = members.overridden(spark.createDataFrame(sorted(types), "sub int, super int"), spark.createDataFrame(declared, "id string, owner int, name string, abstract boolean"))
    assert {tuple(r) for r in found.collect()} == expected
    assert members.overridden(spark.createDataFrame([], "sub int, super int"), spark.createDataFrame(declared, "id string, owner int, name string, abstract boolean")).isEmpty()


@pytest.mark.parametrize("size", ["40b", "1k", "128m"])
def test_records_with_any_split(spark, tmp_path, size):
    rnd = random.Random(1)
    texts = {}
    for name in ("a", "b", "c"):
        lines = ["before it begins"] + [f"{i} > {'é' * rnd.randrange(30)}" if rnd.random() < 0.3 else "  more" * rnd.randrange(4) for i in range(120)]
        texts[name] = "\r\n".join(lines) if name == "b" else "\n".join(lines) + "\n"
    texts["c"] = ""
    for name, text in texts.items():
        (tmp_path / f"{name}.log").write_bytes(text.encode())
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        lines = files.split_lines(spark, str(tmp_path), "log")
        found = {(r.path[-5], r.number, r.line) for r in lines.collect()}
        records = {(r.path[-5], r.number, r.record) for r in files.records(lines, F.col("line").rlike("^[0-9]+ >")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = {name: text.removesuffix("\n").split("\r\n" if name == "b" else "\n") if text else [] for name, text in texts.items()}
    assert found == {(name, i, line) for name, rows in plain.items() for i, line in enumerate(rows, 1)}
    expected = set()
    for name, rows in plain.items():
        starts = [i for i, line in enumerate(rows) if i == 0 or re.match("[0-9]+ >", line)]
        expected |= {(name, a + 1, "\n".join(rows[a:b])) for a, b in zip(starts, [*starts[1:], len(rows)], strict=False)}
    assert records == expected
