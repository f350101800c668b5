"""Use counts of imports: one shuffle by file, and the counts of plain Python on odd tables."""

import random
from collections import Counter

import pytest
from pareframe.operators import imports
from pareframe.plans import catalogue

KINDS = ("file string, path string, alias string, star boolean", "file string, path string, name string", "file string, name string", "file string, package string")


def parent(path):
    return path.rpartition(".")[0]


def short(path):
    return path.rpartition(".")[2]


def needed(uses, own):
    """Uses by (file, path, name) that an import must serve."""
    kept, names = Counter(u for u in uses if None not in u[:2]), {}
    for file, path, name in kept:
        names.setdefault((file, path), set()).add(name)
    return {(f, p, x): n for (f, p, x), n in kept.items() if parent(p) != own.get(f) or names[f, p] != {short(p)}}


def expected(table, uses, lost, packages):
    own, lost, found = dict(packages), Counter(lost), []
    must = needed(uses, own)
    for file, path, alias, star in table:
        if star:
            by_name = {(f, p) for f, p, a, s in table if not s and a is None}
            n = sum(n for (f, p, _), n in must.items() if (f, parent(p)) == (file, path) and path and (f, p) not in by_name)
        else:
            gives = alias if alias is not None else None if path is None else short(path)
            n = must.get((file, path, gives), 0) + (lost[file, gives] if None not in (file, gives) else 0)
        found += [(file, path, alias, star, n)] if n else []
    return found


def odd(seed):
    rng = random.Random(seed)
    files, paths = ["f", "g", "h", None], ["p.A", "p.B", "p.q.A", "p.q", "A", "p", "", "r.p.A", ".A", "p.", None]
    some = lambda n, row: [row() for _ in range(n)]
    table = some(60, lambda: (rng.choice(files), rng.choice(paths), rng.choice([None, None, "A", "X"]), rng.random() < 0.4))
    uses = some(80, lambda: (rng.choice(files), path := rng.choice(paths), "X" if path is None or rng.random() < 0.1 else short(path)))
    lost = some(20, lambda: (rng.choice(files), rng.choice(["A", "B", "X", "", None])))
    return table, uses, lost, [("f", "p"), ("g", "")]


@pytest.mark.parametrize("seed", range(4))
def test_odd_tables(spark, seed):
    rows = odd(seed)
    frames = [spark.createDataFrame(x, kind) for x, kind in zip(rows, KINDS, strict=True)]
    got = [tuple(r) for r in imports.used_imports(*frames).collect()]
    assert sorted(got, key=str) == sorted(expected(*rows), key=str) != []
    must = {(r.file, r.path, r.name): r.n for r in imports.needing_import(frames[1], frames[3]).collect()}
    assert must == needed(rows[1], dict(rows[3]))


def test_empty_tables(spark):
    frames = [spark.createDataFrame([], kind) for kind in KINDS]
    assert imports.used_imports(*frames).collect() == []


def shuffles(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("FileScan")


def test_dealt_out_by_file_once(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [spark.createDataFrame(x, kind) for x, kind in zip(odd(0), KINDS, strict=True)]
        assert shuffles(imports.used_imports(*frames)) == (1, 0)
        # lines and parts by part, what is joined by file
        assert shuffles(catalogue.queries()["import_usage"](spark, sf_dir)) == (3, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
