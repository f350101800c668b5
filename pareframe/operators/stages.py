"""Reduction in stages: each stage searches the rows that the one before has kept, in a transaction of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareframe.operators import graph, reduction, search
from pareframe.operators.snapshot import Snapshot, TransactionFailed

SEARCHES: dict[str, reduction.Search] = {"ddmin": search.ddmin, "ddmin_zero": partial(search.ddmin, zero=True), "pdd": search.pdd}


#: Ways to tell whether a failure is the baseline's: the same, or only that there is one.
COMPARATORS: dict[str, Callable[[object, object], bool]] = {"equal": lambda a, b: a == b, "any": lambda a, b: True}


@dataclass(frozen=True)
class Settings:
    """How a run searches. Frozen, so that nothing changes while it goes."""

    search: str = "ddmin"
    stages: tuple[str, ...] = ("function", "graph", "file")
    comparator: str = "equal"

    @property
    def find(self) -> reduction.Search:
        return SEARCHES[self.search]

    @property
    def similar(self) -> Callable[[object, object], bool]:
        return COMPARATORS[self.comparator]


def keep_found(data: DataFrame, key: str, make: Callable[[DataFrame], search.Property], find: reduction.Search) -> DataFrame:
    """The rows of ``data`` whose ``key`` a search keeps. ``make`` gives the property of numbered distinct keys."""
    items = search.numbered(data.select(key).distinct(), key)
    test = make(items)
    kept = search.retained(items, find(test)).where("retained").select(key)
    return data.join(kept, key, "left_semi")


def keep_levels(data: DataFrame, keys: list[str], make: Callable[[DataFrame], search.Decided], find: reduction.Search) -> DataFrame:
    """The rows of ``data`` that a search by levels keeps: the first of ``keys``, then the second below what stayed, and so on.

    ``make`` gives the property of a level's numbered items: idx, and the keys of the level. No key may be null.
    """
    place = lambda n: F.array(*(F.col(k).cast("string") for k in keys[:n]))
    depth = 0

    def following(kept: DataFrame | None) -> reduction.Level | None:
        nonlocal depth
        if depth == len(keys):
            return None
        depth += 1
        items = data.select(place(depth).alias("id")).distinct()
        if kept is not None:
            items = items.join(kept.select(F.col("id").alias("parent")), F.slice("id", 1, depth - 1) == F.col("parent"), "left_semi")
        return str(depth), items

    def tester(name: str, items: DataFrame) -> search.Decided:
        known = data.select(place(int(name)).alias("id"), *keys[: int(name)]).distinct()
        return make(items.join(known, "id").drop("id"))

    found = reduction.hierarchical(following, find, tester)
    if found is None:
        return data
    last = found.where(F.col("level") == str(len(keys))).select(F.col("id").alias("__id"))
    return data.join(last, place(len(keys)) == F.col("__id"), "left_semi")


def keep_graph(data: DataFrame, edges: DataFrame, find: reduction.Search, key: str = "id", **property) -> DataFrame:
    """The rows of ``data`` whose ``key`` a search over the graph of ``edges`` (src, dst) keeps; cycles stay or go whole.

    ``property`` is targets, holds or states, as for ``reduction.graph_reduction``. Edges with an end that is gone don't count.
    """
    ids = data.select(F.col(key).alias("id")).distinct()
    found = reduction.graph_reduction_condensed(ids, graph.induced(edges, ids), search=find, **property)
    return data.join(found.where("retained").select(F.col("id").alias(key)), key, "left_semi")


@dataclass
class Pipeline:
    """Stages by name: functions of (data, settings) that return fewer rows."""

    stages: dict[str, Callable[[DataFrame, Settings], DataFrame]]

    def run(self, data: DataFrame, settings: Settings) -> Snapshot:
        state = Snapshot(data)
        for name in settings.stages:
            state.transaction(lambda rows, stage=self.stages[name]: stage(rows, settings))
        return state


def benchmark(projects: DataFrame, suitable: Callable[[DataFrame], DataFrame], load: Callable[[str], DataFrame], pipeline: Pipeline, settings: Settings) -> DataFrame:
    """A report on the ``suitable`` ones of ``projects`` (name): rows before and after, and the ratio.

    Projects are reduced one after another, each by its own Spark jobs; a manifest is a short list. One in which there
    is no failure to begin with has null for what is left.
    """
    spark, rows = projects.sparkSession, []
    for name in sorted(r.name for r in suitable(projects).select("name").collect()):
        data = load(name)
        before = data.count()
        try:
            after = pipeline.run(data, settings).data.count()
        except (search.NoFailure, TransactionFailed):
            after = None
        rows.append((name, before, after, after / before if after is not None and before else None))
    return spark.createDataFrame(rows, "name string, before long, after long, ratio double")
