"""Graph operators against small Python versions, on random graphs."""

import random

import pytest
from pareframe.operators import components, graph, pointers, reduction
from pyspark.sql import functions as F


def random_graph(spark, seed, cyclic, n=14):
    rnd = random.Random(seed)
    edges = {(i, rnd.randrange(i)) for i in range(1, n)} | {tuple(sorted(rnd.sample(range(n), 2), reverse=True)) for _ in range(n // 2)}
    if cyclic:
        edges |= {tuple(rnd.sample(range(n), 2)) for _ in range(n // 3)} | {(3, 3)}
    vertices = spark.createDataFrame([(i,) for i in range(n)], "id long")
    return range(n), edges, vertices, spark.createDataFrame(sorted(edges), "src long, dst long")


def reached(edges, start):
    seen, front = set(start), set(start)
    while front:
        front = {b for a, b in edges if a in front} - seen
        seen |= front
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_components_and_condensation(spark, seed):
    ids, edges, vertices, table = random_graph(spark, seed, True)
    reach = {i: reached(edges, {i}) for i in ids}
    expected = {i: min(j for j in reach[i] if i in reach[j]) for i in ids}
    found = graph.strong_components(vertices, table)
    assert {r.id: r.component for r in found.collect()} == expected
    condensed = {(expected[a], expected[b]) for a, b in edges if expected[a] != expected[b]}
    assert {tuple(r) for r in graph.condense(table, found).collect()} == condensed


@pytest.mark.parametrize("seed", range(3))
def test_layers_depths_cascade(spark, seed):
    ids, edges, vertices, table = random_graph(spark, seed, False)
    layer, depth = {}, {}
    for i in ids:
        layer[i] = max((layer[b] + 1 for a, b in edges if a == i), default=0)
    for i in reversed(ids):
        depth[i] = max((depth[a] + 1 for a, b in edges if b == i), default=0)
    assert {r.id: r.layer for r in graph.layer_numbers(vertices, table).collect()} == layer
    assert {r.id: r.depth for r in graph.depths(vertices, table).collect()} == depth
    gone = reached({(b, a) for a, b in edges}, {2})
    assert {r.id for r in graph.cascade(vertices, table, spark.createDataFrame([(2,)], "id long")).where("deleted").collect()} == gone


@pytest.mark.parametrize("cyclic", [False, True])
def test_graph_reduction(spark, cyclic):
    ids, edges, vertices, table = random_graph(spark, 9, cyclic)
    targets = {5, 9}
    reduce = reduction.graph_reduction_condensed if cyclic else reduction.graph_reduction
    found = reduce(vertices, table, spark.createDataFrame([(t,) for t in targets], "id long")).collect()
    assert {r.id for r in found} == set(ids)
    assert {r.id for r in found if r.retained} == reached(edges, targets)


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(18)] + [(40 + i, 41 + i) for i in range(12)] + [(70, 70), (None, 3)]
    both = {e for e in edges if None not in e} | {(b, a) for a, b in edges if None not in (a, b)}
    expected = {i: min(reached(both, {i})) for e in both for i in e}
    found = components.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id: r.component for r in found.collect()} == expected
    assert len(found.collect()) == len(expected)


def test_empty_graph(spark):
    none, edges = spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long")
    assert components.connected_components(edges).collect() == []
    assert graph.strong_components(none, edges).collect() == []
    assert graph.layer_numbers(none, edges).collect() == []
    assert graph.depths(none, edges).collect() == []
    assert reduction.graph_reduction(none, edges, none).collect() == []


def test_dot(spark):
    text = graph.to_dot(spark.createDataFrame([("a", 'b"', "k")], "src string, dst string, kind string"))
    assert text == 'digraph {\n  "a" -> "b\\"" [label="k"];\n}'


LONG = 2000


def checked_layers(spark, edges, n):
    """Layers and depths against plain Python, of ids 0 to n - 1."""
    need, needed = {}, {}
    for a, b in edges:
        need.setdefault(a, set()).add(b)
        needed.setdefault(b, set()).add(a)

    def numbers(out, back):
        left, layer = {i: len(out.get(i, ())) for i in range(n)}, {}
        front = [i for i in range(n) if not left[i]]
        for i in front:
            layer[i] = max((layer[j] + 1 for j in out.get(i, ())), default=0)
            for j in back.get(i, ()):
                left[j] -= 1
                if not left[j]:
                    front.append(j)
        return layer

    table = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {r.id: r.layer for r in graph.layer_numbers(spark.range(n), table).collect()} == numbers(need, needed)
    assert {r.id: r.depth for r in graph.depths(spark.range(n), table).collect()} == numbers(needed, need)


@pytest.fixture
def far(monkeypatch):
    """Nothing is finished on the driver."""
    monkeypatch.setattr(graph, "SMALL", 0)


def test_layers_of_a_long_chain(spark, far):
    table = spark.range(1, LONG).select("id", (F.col("id") - 1).alias("before"))
    layers = graph.layer_numbers(spark.range(LONG), table.toDF("src", "dst"))
    assert {r.id: r.layer for r in layers.collect()} == {i: i for i in range(LONG)}


@pytest.mark.parametrize("seed", range(4))
def test_layers_of_chains_trees_and_cycles(spark, seed, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", [0, 0, 20, 1000][seed])
    rnd = random.Random(seed)
    n = 60
    edges = {(i, i - 1) for i in range(1, 25)} | {(i, rnd.randrange(max(0, i - 4), i)) for i in range(25, 45)}
    edges |= {(i, i - 1) for i in range(46, 52)} | {(rnd.randrange(30, 45), rnd.randrange(10)) for _ in range(4)}
    if seed % 2:
        edges |= {(52, 53), (53, 54), (54, 52), (55, 52), (53, 3), (56, 55), (57, 57), (58, 57)}
    checked_layers(spark, edges, n)


def test_reach_along_a_long_chain(spark, far):
    table = spark.range(1, LONG).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    start = spark.createDataFrame([(0, 0), (7, 1000)], "root long, id long")
    found = graph.reach(start, table)
    assert sorted(map(tuple, found.collect())) == sorted([(0, i) for i in range(LONG)] + [(7, i) for i in range(1000, LONG)])


@pytest.mark.parametrize("seed", range(4))
def test_reach_and_components_with_chains(spark, seed, monkeypatch):
    # long paths, branchings, circles within circles, circles that nothing leads to
    monkeypatch.setattr(graph, "PLAIN", seed % 3)
    monkeypatch.setattr(graph, "SMALL", [0, 0, 15, 1000][seed])
    rnd = random.Random(seed)
    n = 80
    edges = {(i, i + 1) for i in range(30)} | {(i, i + 1) for i in range(40, 60)} | {(60, 40), (12, 45), (50, 3)} | {(62, 63), (63, 62), (63, 5), (70, 70)}
    edges |= {tuple(rnd.sample(range(n), 2)) for _ in range(seed * 6)}
    table = spark.createDataFrame(sorted(edges), "src long, dst long")
    roots = rnd.sample(range(n), 5)
    found = graph.reach(spark.createDataFrame([(r, r) for r in roots], "root long, id long"), table)
    assert sorted(map(tuple, found.collect())) == sorted((r, i) for r in roots for i in reached(edges, {r}))
    reach = {i: reached(edges, {i}) for i in range(n)}
    expected = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}
    assert {r.id: r.component for r in graph.strong_components(spark.range(n), table).collect()} == expected


@pytest.mark.parametrize("closed", [False, True])
def test_components_of_a_long_chain(spark, far, closed):
    table = spark.range(1, LONG).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    if closed:
        table = table.union(spark.createDataFrame([(LONG - 1, 0)], "src long, dst long"))
    found = graph.strong_components(spark.range(LONG), table)
    assert {r.id: r.component for r in found.collect()} == {i: 0 if closed else i for i in range(LONG)}


def test_one_next_row_each(spark):
    # chains to 9 and to 5, and a circle with a way into it
    rows = [(1, 2, 1), (2, 3, 2), (3, 9, 4), (4, 5, 1), (6, 7, 8), (7, 8, 16), (8, 6, 32), (0, 7, 64)]
    found = pointers.jumped(spark.createDataFrame(rows, "id long, next long, w long"), {"w": F.col("w").bitwiseOR(F.col("w2"))})
    ends = {r.id: (None if r.open else r.next, r.w) for r in found.collect()}
    assert ends == {1: (9, 7), 2: (9, 6), 3: (9, 4), 4: (5, 1), 6: (None, 56), 7: (None, 56), 8: (None, 56), 0: (None, 120)}
