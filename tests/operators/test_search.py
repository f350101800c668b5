"""Searches: what they keep has the property, is 1-minimal, and is the target where that is unique."""

import random

import pytest
from pareframe.operators import graph, reduction, search, trace
from pyspark.sql import functions as F


def universe(spark, n, targets, bad=()):
    rows = [(i, i, int(i in targets), int(i in bad)) for i in range(n)]
    return spark.createDataFrame(rows, "idx long, item_id long, wanted int, bad int").cache()


def members(ranges):
    return {i for a, b in ranges for i in range(a, b)}


@pytest.mark.parametrize("find", [search.ddmin, search.pdd])
@pytest.mark.parametrize("seed", range(4))
def test_target_is_found(spark, find, seed):
    rnd = random.Random(seed)
    n = rnd.randrange(10, 60)
    targets = set(rnd.sample(range(n), rnd.randrange(1, 4)))
    assert members(find(reduction.contains_all(universe(spark, n, targets), "wanted"))) == targets


def test_all_or_none(spark):
    targets, bad = {7}, {2, 3}
    test = search.Property(universe(spark, 16, targets, bad), {"wanted": F.col("wanted"), "bad": F.col("bad")}, lambda s: s["wanted"] == 1 and s["bad"] in (0, 2))
    assert members(search.ddmin(test)) in (targets, targets | bad)


def test_hints_cost_no_more_tests(spark):
    targets = {3, 31}
    items = universe(spark, 40, targets)
    plain, hinted = (reduction.contains_all(items, "wanted") for _ in range(2))
    assert members(search.pdd(plain)) == members(search.pdd(hinted, ((3, 4), (31, 32)))) == targets
    assert len(hinted.log) <= len(plain.log)


def test_zero_and_no_failure(spark):
    items = universe(spark, 9, set())
    always = search.Property(items, {"n": F.lit(1)}, lambda s: True)
    assert search.ddmin(always, zero=True) == ()
    with pytest.raises(search.NoFailure):
        search.ddmin(search.Property(items, {"n": F.lit(1)}, lambda s: False))
    one = search.Property(items, {"n": F.lit(1)}, lambda s: s["n"] >= 1)
    assert search.size(search.ddmin(one, zero=True)) == 1


def test_each_set_is_decided_once(spark):
    test = reduction.contains_all(universe(spark, 20, {4, 15}), "wanted")
    search.ddmin(test)
    assert len(test.log) == len(test.memo)


def test_ranges():
    assert search.chunks(((0, 3), (5, 9)), 2) == [((0, 3),), ((5, 9),)]
    assert search.without(((0, 9),), ((2, 3), (5, 7))) == ((0, 2), (3, 5), (7, 9))
    assert search.merged([1, 2, 4]) == ((1, 3), (4, 5))
    rnd = random.Random(1)
    for _ in range(200):
        now = search.merged(sorted(rnd.sample(range(50), rnd.randrange(1, 40))))
        parts = search.chunks(now, rnd.randint(1, search.size(now)))
        assert members(now) == set().union(*map(members, parts)) and sum(map(search.size, parts)) == search.size(now)
        assert members(search.without(now, parts[0])) == members(now) - members(parts[0])


def test_numbers_are_dense(spark):
    items = spark.range(100).select((F.col("id") * 37 % 101).alias("k")).repartition(5)
    found = search.numbered(items, "k").orderBy("k").collect()
    assert [r.idx for r in found] == list(range(100))


def test_hierarchy(spark):
    tops = spark.createDataFrame([(1, None, 1), (2, None, 0)], "id long, parent long, wanted int")
    leaves = spark.createDataFrame([(10, 1, 0), (11, 1, 1), (12, 2, 0)], "id long, parent long, wanted int")
    found = {tuple(r) for r in reduction.hierarchical([("top", tops), ("leaf", leaves)]).collect()}
    assert found == {("top", 1), ("leaf", 11)}


@pytest.mark.parametrize("n", [2, 4, 8, 16, 64])
def test_pdd_keeps_one_item(spark, n):
    always = search.Property(universe(spark, n, set()), {"n": F.lit(1)}, lambda s: True)
    assert search.size(search.pdd(always)) == 1
    assert all(x["retained"] > 0 for x in always.log)
    assert search.pdd(search.Property(universe(spark, n, set()), {"n": F.lit(1)}, lambda s: True), zero=True) == ()
    assert members(search.pdd(reduction.contains_all(universe(spark, n, {0}), "wanted"))) == {0}


@pytest.mark.parametrize("find", [search.ddmin, search.pdd])
@pytest.mark.parametrize("local", [0, 4096])
def test_sums_far_and_near(spark, monkeypatch, find, local):
    monkeypatch.setattr(search, "LOCAL", local)
    targets = {5, 17, 40}
    assert members(find(reduction.contains_all(universe(spark, 64, targets), "wanted"))) == targets


@pytest.mark.parametrize("find", [search.ddmin, search.pdd])
def test_property_that_is_no_sum(spark, find):
    """The smallest product of two retained items' numbers must stay: no sum of items tells."""
    items = spark.createDataFrame([(i, v) for i, v in enumerate([9, 4, 7, 3, 8, 6, 5, 2])], "idx long, v long")
    ends = lambda rows: tuple(rows.agg(F.min("v"), F.max("v")).first())
    seen = []

    def test(retained, deleted):
        assert retained.count() + deleted.count() == 8
        seen.append(retained.count())
        return ends(retained) == (2, 9)

    assert members(find(search.Tested(items, test))) == {0, 7}
    assert seen


def test_same_failure(spark):
    """Outcomes are told apart, and another failure isn't the one that is looked for."""
    items = spark.range(12).select(F.col("id").alias("idx"), F.col("id").alias("v"))

    def run(rows):
        values = {r.v for r in rows.collect()}
        return "deep" if {3, 8} <= values else "shallow" if 3 in values else None

    test = search.same_failure(items, run, lambda a, b: a == b)
    assert test.baseline == "deep"
    assert members(search.ddmin(test)) == {3, 8}
    assert {x["verdict"] for x in test.log} == {search.SAME, search.NONE, search.OTHER}
    with pytest.raises(search.NoFailure):
        search.same_failure(items.where("v > 3"), run, lambda a, b: True)


def test_sets_have_keys_of_their_own():
    a, b = ((0, 4), (6, 9)), ((2, 4), (6, 7))
    assert (search.key(a) - search.key(b)) % (1 << 128) == search.key(search.without(a, b))
    assert search.key(((0, 2), (2, 5))) == search.key(((0, 5),))
    assert search.key(()) == 0 != search.key(((0, 1),))


def test_generated_levels(spark):
    tree = spark.createDataFrame([(1, None, 1), (2, None, 1), (10, 1, 2), (11, 1, 2), (12, 2, 2)], "id long, parent long, depth int")
    asked = []

    def following(kept):
        asked.append(None if kept is None else sorted(r.id for r in kept.collect()))
        level = tree.where(F.col("depth") == len(asked))
        return (f"level {len(asked)}", level if kept is None else level.join(kept.withColumnRenamed("id", "parent"), "parent", "left_semi"))

    tester = lambda name, items: search.Tested(items, lambda kept, out: kept.where("id IN (1, 11)").count() == 1)
    found = {tuple(r) for r in reduction.hierarchical(following, tester=tester).collect()}
    assert found == {("level 1", 1), ("level 2", 11)} and asked == [None, [1], [11]]


@pytest.mark.parametrize("seed", range(3))
def test_graph_reduction_of_any_property(spark, seed):
    """All ways of deciding give the closure of the targets, by layers and over condensed graphs."""
    rnd = random.Random(seed)
    n = 14 if seed else 6
    edges = {(i, rnd.randrange(i)) for i in range(1, n) for _ in range(2)}
    targets = set(rnd.sample(range(n), 2))
    vertices, links = spark.range(n), spark.createDataFrame(sorted(edges), "src long, dst long")
    wanted, todo = set(), list(targets)
    while todo:
        v = todo.pop()
        if v not in wanted:
            wanted.add(v)
            todo += [b for a, b in edges if a == v]
    kept = lambda df: {r.id for r in df.where("retained").collect()}
    goals = spark.createDataFrame([(t,) for t in targets], "id long")
    holds = lambda left: goals.join(left, "id", "left_anti").isEmpty()
    assert kept(reduction.graph_reduction(vertices, links, goals)) == wanted
    # the states are the least and the greatest target that is left
    ends = {"least": search.least(F.col("goal")), "most": search.most(F.col("goal"))}
    states = reduction.States(goals.withColumn("goal", F.col("id")), ends, lambda found: found == {"least": min(targets), "most": max(targets)})
    assert kept(reduction.graph_reduction(vertices, links, states=states)) == wanted
    if seed == 0:
        assert kept(reduction.graph_reduction(vertices, links, holds=holds)) == wanted
        cyclic = links.union(spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"))
        both = wanted | ({0, 1} if wanted & {0, 1} else set())
        assert kept(reduction.graph_reduction_condensed(vertices, cyclic, holds=holds)) == both == kept(reduction.graph_reduction_condensed(vertices, cyclic, goals))
        assert kept(reduction.graph_reduction_condensed(vertices, cyclic, states=states)) == both


@pytest.mark.parametrize("small", [0, 1000])
def test_long_paths(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    edges = spark.range(1, 12).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    assert graph.reach(spark.createDataFrame([(0, 0)], "root long, id long"), edges).count() == 12
    layers = {r.id: r.layer for r in graph.layer_numbers(spark.range(12), edges).collect()}
    assert layers == {i: 11 - i for i in range(12)}


def test_states_that_need_too_much(spark, monkeypatch):
    """Where too many groups of vertices would come to the driver, each candidate takes a job, with the same result."""
    edges = spark.createDataFrame([(3, 0), (4, 1), (5, 2), (5, 1)], "src long, dst long")
    ends = {"most": search.most(F.col("id"))}
    states = reduction.States(spark.range(6).withColumn("most", F.col("id")), ends, lambda found: found["most"] == 5)
    asked = []
    monkeypatch.setattr(reduction, "Tested", lambda *a: asked.append(1) or search.Tested(*a))
    expected = {1, 2, 5}
    kept = lambda: {r.id for r in reduction.graph_reduction(spark.range(6), edges, states=states).where("retained").collect()}
    assert kept() == expected and not asked
    monkeypatch.setattr(reduction, "SIGNATURES", 1)
    assert kept() == expected and asked


@pytest.mark.parametrize("find", [search.ddmin, search.pdd])
@pytest.mark.parametrize("local", [0, 4, 4096])
def test_merged_states_decide_as_single_runs_do(spark, monkeypatch, find, local):
    """Least, greatest and set of values: the same answer and the same log, wherever states are merged."""
    monkeypatch.setattr(search, "LOCAL", local)
    rnd = random.Random(local)
    rows = [(i, rnd.choice([None, *range(9)]), rnd.choice("abc")) for i in range(14)]
    items = spark.createDataFrame(rows, "idx long, v long, k string")

    def run(kept):
        r = kept.agg(F.min(F.struct("v", "idx")).alias("least"), F.max(F.struct("v", "idx")).alias("most"), F.array_sort(F.collect_set("k")).alias("k"), F.count("*").alias("n")).first()
        return None if not r.n else (tuple(r.least), tuple(r.most), list(r.k))

    at = F.struct("v", "idx")
    merged = search.same_state(items, {"least": search.least(at), "most": search.most(at), "k": search.distinct(F.col("k"))})
    single = search.same_failure(items, run, lambda a, b: a == b)
    assert find(merged) == find(single)
    assert merged.log == single.log
    assert merged.baseline == dict(zip(["least", "most", "k"], single.baseline, strict=True))


def test_states_of_nothing(spark):
    none = spark.createDataFrame([], "idx long, v long")
    with pytest.raises(search.NoFailure):
        search.same_state(none, {"least": search.least(F.col("v"))})
    empty = search.same_state(spark.range(3).select(F.col("id").alias("idx"), F.lit(1).alias("v")), {"v": search.distinct(F.col("v"))})
    assert search.size(search.ddmin(empty, zero=True)) == 1
    assert {x["verdict"] for x in empty.log} == {search.SAME, search.NONE}


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_candidates_as_a_key(spark, monkeypatch, batch):
    """A median has no state to merge: candidates are run together, and decide as single runs do."""
    monkeypatch.setattr(search, "BATCH", batch)
    items = spark.createDataFrame([(i, v) for i, v in enumerate([5, 1, 9, 5, 7, 3, 8, 2, 5])], "idx long, v long")
    medians = []

    def run(rows):
        medians.append(rows)
        return rows.groupBy("candidate").agg(F.expr("percentile(v, 0.5)").alias("median"), F.count("*").alias("n"))

    holds = lambda r: r is not None and r["median"] == 5 and r["n"] >= 3
    grouped = search.Grouped(items, run, holds)

    def alone(kept, out):
        r = kept.agg(F.expr("percentile(v, 0.5)").alias("median"), F.count("*").alias("n")).first()
        return holds(r.asDict())

    single = search.Tested(items, alone)
    assert search.ddmin(grouped) == search.ddmin(single)
    assert grouped.log == single.log
    if batch == 100:
        assert len(medians) < len(single.log)


def test_sums_of_doubles_are_refused(spark):
    with pytest.raises(ValueError):
        search.Property(spark.range(3).withColumnRenamed("id", "idx"), {"x": F.lit(0.1)}, lambda s: True)


def test_trace_of_a_search(spark, tmp_path):
    """Events are what the log says, in order, within their levels; a level without items has one of its own."""
    tree = spark.createDataFrame([(1, None, 1, 5), (2, None, 1, 9), (10, 1, 2, 5), (11, 1, 2, 7), (12, 2, 2, 9)], "id long, parent long, depth int, v int")
    tests, depth = {}, 0

    def following(kept):
        nonlocal depth
        depth += 1
        level = tree.where(F.col("depth") == depth)
        return str(depth), level if kept is None else level.join(kept.withColumnRenamed("id", "parent"), "parent", "left_semi")

    def tester(name, items):
        tests[name] = search.same_state(items, {"most": search.most(F.col("v"))}, lambda a, b: a == b)
        return tests[name]

    events = trace.Trace(spark, str(tmp_path / "events"))
    found = {tuple(r) for r in reduction.hierarchical(following, tester=tester, trace=events).collect()}
    assert found == {("1", 2), ("2", 12)}
    rows = trace.read(spark, events.place).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(events.n))
    assert [(r.event, r.name, r["items"]) for r in rows if r.event not in ("run", "comparison")] == [("level", "1", 2), ("level", "2", 1), ("empty level", "3", None)]
    for name, test in tests.items():
        mine = [r for r in rows if r.levels == [name]]
        assert [(r.kind, r["items"], r.verdict) for r in mine] == [(x["kind"], x["retained"], x["verdict"]) for x in test.log]
        assert all((r.event == "comparison") == (r.verdict != search.NONE) for r in mine)
        assert all(r.same == (r.found == r.baseline) for r in mine if r.event == "comparison")
    totals = {(r.level, r.event, r.verdict): r.n for r in trace.totals(trace.read(spark, events.place)).collect()}
    assert sum(totals.values()) == events.n and totals["1", "level", None] == 1
