"""The manifest and its climb against plain Python."""

import hashlib
import string
import zlib

import pytest
from helpers import SCHEMA, collect
from pareframe.llm import merkle

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def climbed(tree, at, digest):
    """The siblings on the way up from a node, and the digest there."""
    siblings = []
    for level in tree[:-1]:
        first = at - at % 16
        run = level[first : first + 16]
        siblings += run[: at - first] + run[at - first + 1 :]
        digest = h(*run[: at - first], digest, *run[at - first + 1 :])
        at //= 16
    return siblings, digest


def expected(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0], leaf(r[0], r[3], r[2], r[4], r[1]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in sources[s]])
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, (doc_id, own, r) in enumerate(sources[s]):
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            text = r[1] if r[1] is None or not hit else r[1].translate(LOWER)
            low, digest = climbed(trees[s], i, leaf(doc_id, s, r[2], r[4], text))
            high, digest = climbed(top, k, digest)
            yield doc_id, own, trees[s][-1][0], top[-1][0], h(*low, *high), digest, digest == top[-1][0]


def table(sizes):
    rows = []
    for k, (source, n) in enumerate(sizes):
        rows += [(j * 7 % 4001 - 5, f"Text {j} É\n{'Ab ' * (j % 9)}", "en" if j % 3 else None, source, j) for j in range(n)]
        rows += [(k, None, None, source, None)] if n > 4 else []
    return rows


CASES = {
    "several sources": table([("src0", 700), ("b", 16), ("a", 17), (None, 5), ("é", 1), ("Z", 40), ("", 3), ("c", 257)]),
    "one source": table([("s", 300)]),
    "one leaf": [(5, "ABC", "en", "s", 3)],
    "one leaf a source": [(i, "A B", None, f"s{i:03}", 1) for i in range(40)],
    "repeated rows and null ids": [(None, "X", "en", "s", 1), (None, "Y", "en", "s", 1), *[(10, "Same Text", "de", "t", 9)] * 70, (None, None, None, None, None)],
    "a very long text": [(i, "Long É " * 200_000, "en", "s", i) for i in range(3)],
}


@pytest.mark.parametrize("name", CASES)
def test_report(spark, name):
    rows = CASES[name]
    documents = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r.values()) for r in collect(merkle.manifest_report(documents))]
    assert sorted(found, key=str) == sorted(expected(rows), key=str)


def test_columns_of_any_name(spark):
    rows = table([("s", 30)])
    documents = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{SCHEMA}, `a.b` int, leaf int")
    assert sorted(map(tuple, merkle.manifest_report(documents).collect()), key=str) == sorted(expected(rows), key=str)


def test_copies_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PASSING", 1)
    rows = table([("s", 600), ("t", 20)])
    assert sorted(map(tuple, merkle.manifest_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == sorted(expected(rows), key=str)


def test_empty_table(spark, empty):
    found = merkle.manifest_report(empty)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.isEmpty()


def test_limit_of_rows_is_given_back(spark, documents):
    before = spark.conf.get(merkle.LIMIT)
    merkle.manifest_report(documents).count()
    assert spark.conf.get(merkle.LIMIT) == before
