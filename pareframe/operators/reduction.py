"""Hierarchical and graph reduction: searches that go level by level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareframe.operators import graph
from pareframe.operators.search import LOCAL, Decided, Partial, Property, Ranges, Surviving, Tested, ddmin, numbered_and_counted, plain, retained
from pareframe.operators.trace import Trace
from pareframe.sources.tables import fresh, keep

#: Called with a property, and ``zero`` where the empty set is to be tried.
Search = Callable[..., Ranges]
Level = tuple[str, DataFrame]


def contains_all(items: DataFrame, wanted: str) -> Property:
    """The property "no wanted thing is lost": ``wanted`` is a column with the number of them in each item."""
    test = Property(items, {"wanted": F.col(wanted)}, lambda s: True)
    test.holds = lambda s: s["wanted"] == test.total["wanted"]
    return test


def below(levels: list[Level]) -> Callable[[DataFrame | None], Level | None]:
    """A generator of levels from ready ones: of each, the items whose ``parent`` was kept on the level above."""
    left = iter(levels)

    def following(kept: DataFrame | None) -> Level | None:
        name, level = next(left, (None, None))
        if level is None or kept is None:
            return level if level is None else (name, level)
        return name, level.join(kept.select(F.col("id").alias("parent")), "parent", "left_semi")

    return following


def hierarchical(
    levels: list[Level] | Callable[[DataFrame | None], Level | None],
    search: Search = ddmin,
    tester: Callable[[str, DataFrame], Decided] = lambda name, items: contains_all(items, "wanted"),
    trace: Trace | None = None,
) -> DataFrame:
    """(level, id) that stay. Each level is searched over what stayed on the one above.

    ``levels`` is a generator: called with the ids that stayed (``id``; None at first), it returns the next level's name
    and items (``id`` and whatever ``tester`` needs), or None; an empty level ends the search, too. A list of levels with
    a column ``parent`` stands for ``below`` of it. ``tester`` makes the property of a level's numbered items; by default
    it is that nothing ``wanted`` is lost. ``trace`` is told of levels, and of what is decided in them.
    """
    following = below(levels) if isinstance(levels, list) else levels
    out, kept = None, None
    while (level := following(kept)) is not None:
        name, items = level
        items, n = numbered_and_counted(items, "id")
        if not n:
            if trace is not None:
                trace.empty(name)
            break
        if trace is None:
            ranges = search(tester(name, items))
        else:
            with trace.level(name, n):
                ranges = search(trace.watch(tester(name, items)))
        kept = keep(retained(items, ranges).where("retained").select("id"))
        one = kept.select(F.lit(name).alias("level"), "id")
        out = one if out is None else out.union(one)
    return out


#: Groups of vertices, by what they need of a layer, whose states are held on the driver.
SIGNATURES = 1_000


@dataclass(frozen=True)
class States:
    """The property of a graph's vertices that ``holds`` decides from merged states: of ``rows``, a row (id, ...) for each
    vertex that has any. ``partials`` names the states and says what they are of these rows."""

    rows: DataFrame
    partials: dict[str, Partial]
    holds: Callable[[dict], bool | str]

    def of(self, components: DataFrame) -> States:
        """The same of components (id, component), whose states are those of their members."""
        rows = self.rows.join(components, "id")
        found = rows.groupBy(F.col("component").alias("id")).agg(*(p.aggregate(p.column).alias(k) for k, p in self.partials.items()))
        return States(keep(found), {k: Partial(F.col(k), p.aggregate, p.merge) for k, p in self.partials.items()}, self.holds)

    def hold(self, left: DataFrame) -> bool | str:
        found = self.rows.join(left, "id", "left_semi").agg(*(p.aggregate(p.column).alias(k) for k, p in self.partials.items())).first()
        return self.holds({k: plain(found[k]) for k in self.partials})

    def survivors(self, items: DataFrame, n: int, live: DataFrame, back: DataFrame) -> Surviving | None:
        """The test of a layer's ``n`` numbered ``items``: vertices with a state, grouped by the items that they need.

        None where a vertex needs more than LOCAL of them, or there are more than SIGNATURES groups.
        """
        needed = graph.reach(items.select(F.col("idx").alias("root"), "id"), back)
        if (needed.groupBy("id").count().agg(F.max("count")).first()[0] or 0) > LOCAL:
            return None
        rows = self.rows.join(live, "id", "left_semi").join(needed.groupBy("id").agg(F.array_sort(F.collect_list("root")).alias("needs")), "id", "left")
        groups = rows.groupBy("needs").agg(*(p.aggregate(p.column).alias(k) for k, p in self.partials.items())).limit(SIGNATURES + 1).collect()
        if len(groups) > SIGNATURES:
            return None
        return Surviving(n, [(r["needs"] or [], {k: plain(r[k]) for k in self.partials}) for r in groups], self.partials, self.holds)


def graph_reduction(
    vertices: DataFrame,
    edges: DataFrame,
    targets: DataFrame | None = None,
    search: Search = ddmin,
    holds: Callable[[DataFrame], bool | str] | None = None,
    states: States | None = None,
) -> DataFrame:
    """(id, retained): a small set of vertices that has a property, closed under what its members need.

    Layers are searched in turn, from what needs nothing, the empty set of a layer included (for targets all in one search,
    in that order); deleting a vertex deletes all that need it. The property is ``holds`` of the vertices (id) that are left after such a cut; or that ``states`` of
    them hold; or else that no ``target`` (id) is lost, for which a vertex counts the targets that reach it. For targets
    all candidates of a pass are decided by one job; for states all of a layer are decided from one job, if the vertices
    with a state depend on the layer in at most SIGNATURES ways. Else, and for ``holds``, each takes a job. The graph must
    have no cycles: condense it first.
    """
    ids = keep(vertices.select("id").distinct())
    links = keep(edges.select("src", "dst").distinct())
    back = graph.reverse(links)
    numbers = graph.layer_numbers(ids, links)
    if states is not None:
        holds = states.hold
    if holds is None:
        # no target needs what goes, so the layers don't depend on each other: one search, in their order, serves them all
        needed = graph.reach(targets.select(F.col("id").alias("root"), "id"), links).groupBy("id").agg(F.count("*").alias("wanted"))
        items, n = numbered_and_counted(numbers.join(needed, "id", "left").select("id", "layer", F.coalesce("wanted", F.lit(0)).alias("wanted")), "layer", "id")
        found = retained(items, () if not n else search(contains_all(items, "wanted"), zero=True))
        gone = keep(found.where("NOT retained").select("id"))
        live = ids.join(graph.closure(gone, back), "id", "left_anti")
        return ids.join(live.withColumn("retained", F.lit(True)), "id", "left").withColumn("retained", F.coalesce("retained", F.lit(False)))
    numbers, live = keep(numbers), ids
    last = numbers.agg(F.max("layer")).first()[0]
    for i in range(-1 if last is None else last + 1):
        # what an earlier layer has cut off isn't asked for again
        layer = numbers.where(F.col("layer") == i).drop("layer").join(live, "id", "left_semi")
        items, n = numbered_and_counted(layer, "id")
        if not n:
            continue
        # nothing needs what is in the last layer
        cut = (lambda out: out) if i == last else lambda out: graph.closure(out, back)
        left = live
        test = states and states.survivors(items, n, left, back)
        if test is None:
            test = Tested(items, lambda kept, out, left=left, cut=cut: holds(left.join(cut(out.select("id")), "id", "left_anti")))
        out = keep(retained(items, search(test, zero=True)).where("NOT retained").select("id"))
        if not out.isEmpty():
            live = fresh(live.join(cut(out), "id", "left_anti"))
    return ids.join(live.withColumn("retained", F.lit(True)), "id", "left").withColumn("retained", F.coalesce("retained", F.lit(False)))


def graph_reduction_condensed(
    vertices: DataFrame,
    edges: DataFrame,
    targets: DataFrame | None = None,
    search: Search = ddmin,
    holds: Callable[[DataFrame], bool | str] | None = None,
    states: States | None = None,
) -> DataFrame:
    """As graph_reduction, for graphs with cycles: components are kept or deleted whole. ``holds`` and ``states`` see vertices."""
    components = keep(graph.strong_components(vertices, edges))
    small = components.select(F.col("component").alias("id")).distinct()
    wanted = targets if targets is None else targets.join(components, "id").select(F.col("component").alias("id")).distinct()
    flat = lambda left: components.join(left.withColumnRenamed("id", "component"), "component", "left_semi").select("id")
    found = graph_reduction(small, graph.condense(edges, components), wanted, search, None if holds is None else lambda left: holds(flat(left)), states and states.of(components))
    return components.join(found.withColumnRenamed("id", "component"), "component").select("id", "retained")
