"""Whitening against plain integers and a dense eigendecomposition."""

import math
import random

import numpy as np
import pytest
from helpers import collect
from pareframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n, width, seed=1, spread=1.0):
    rnd = np.random.default_rng(seed)
    mixed = rnd.normal(size=(n, width)) @ rnd.normal(size=(width, width)) * spread + rnd.normal(size=width)
    return [(i, [float(v) for v in row.astype(np.float32)]) for i, row in enumerate(mixed)]


def good(rows, width):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(v is not None and math.isfinite(v) for v in r[1])]


def checked(found, rows, width):
    """Asserts that ``found`` is the whitening of ``rows``, by whole numbers and by definition."""
    rows = good(rows, width)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    cov = np.array([[n * sum(a * b for a, b in zip(p, q, strict=True)) - s[i] * s[j] for j, q in enumerate(zip(*x, strict=True))] for i, p in enumerate(zip(*x, strict=True))], dtype=object)
    v = np.array([[c / n**2 for c in row] for row in cov], dtype=float)
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    k = min(32, width)
    assert len(found) == n * k
    deviation = sorted(sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x)
    assert sorted(r["deviation"] for r in found if r["component"] == 1) == deviation
    assert {r["n"] for r in found} == {n}
    sums, y = np.array(s) / n, {}
    for r in found:
        y.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9, abs=1e-12)
    if n > width and len({i for i, _ in rows}) == n:
        ids = [i for i, _ in rows]
        centred = np.array(x) - sums
        for c, of in y.items():
            w = np.array([of[i] for i in ids])
            # w is (x - S/n) u / sqrt(e): u follows by least squares, and must be a unit eigenvector
            u = np.linalg.lstsq(centred, w, rcond=None)[0] * math.sqrt(e[c - 1])
            assert np.linalg.norm(u) == pytest.approx(1, abs=1e-9)
            assert np.abs(v @ u - e[c - 1] * u).max() <= 1e-9 * e[0]
        w = np.array([[y[c][i] for c in sorted(y)] for i in ids])
        w -= w.mean(axis=0)
        error = np.abs(w.T @ w / n - np.eye(k)).max()
        assert error <= 1e-9 and {r["identity_error"] <= 1e-9 for r in found} == {True}


@pytest.mark.parametrize("width,n,spread", [(5, 200, 1), (40, 300, 0.1), (1, 30, 3), (3, 100, 1e9)])
def test_report(spark, width, n, spread):
    rows = vectors(n, width, spread=spread)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if spread > 1e6:
        # deviations are beyond a long
        model = whitening.fit(table.withColumnRenamed("embedding", "vector"), width)
        x = [[math.floor(64 * float(np.float32(c))) for c in v] for _, v in rows]
        assert list(model.sums) == [sum(c) for c in zip(*x, strict=True)]
        found = [int(r["deviation"]) for r in collect(whitening.whiten(table.withColumnRenamed("embedding", "vector"), model))]
        assert sorted(found) == sorted(sum((n * c - s) ** 2 for c, s in zip(row, model.sums, strict=True)) for row in x)
        return
    checked(collect(whitening.whitening_report(table)), rows, width)


def test_small_blocks(spark, monkeypatch):
    rows = vectors(150, 6)
    table = spark.createDataFrame(rows, SCHEMA).repartition(2)
    monkeypatch.setattr(whitening, "BLOCK", 6 * 7)
    checked(collect(whitening.whitening_report(table)), rows, 6)


def test_scatter_is_exact():
    rnd = random.Random(4)
    for low, high, n, width in [(-40, 40, 130, 5), (0, 0, 3, 2), (-(2**53), 2**53, 70, 3), (5, 6, 1, 4), (-(2**27), 2**27, 65, 2)]:
        x = [[rnd.randint(low, high) for _ in range(width)] for _ in range(n)]
        sums, cross = whitening.scatter(np.array(x, dtype=np.int64))
        columns = list(zip(*x, strict=True))
        assert sums.tolist() == [sum(c) for c in columns]
        assert cross.tolist() == [[sum(a * b for a, b in zip(p, q, strict=True)) for q in columns] for p in columns]


def test_odd_vectors(spark):
    rows = vectors(60, 4)
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [nan, 1.0, 2.0, 3.0]), (104, [1.0, -inf, 0.0, 0.0]), (105, [1.0, 2.0])]
    rows += [*odd, rows[0], rows[0], (None, rows[1][1])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, vector int, `a.b` string").repartition(3)
    checked(collect(whitening.whitening_report(table)), rows, 4)


def test_dimensions_that_do_not_vary(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(10)]
    found = collect(whitening.whitening_report(spark.createDataFrame(rows, SCHEMA)))
    assert len(found) == 30
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in found)
    assert {r["identity_error"] < 1e-9 for r in found} == {True}
    same = collect(whitening.whitening_report(spark.createDataFrame([(1, [1.0, 2.0])] * 5, SCHEMA)))
    assert len(same) == 10 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, None, 0.0, 0)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_no_vectors(spark, rows):
    found = whitening.whitening_report(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.isEmpty()
