"""Hierarchies given as paths: arrays of names, root first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def url_parts(url: Column) -> Column:
    """Domain, host, then the path of a URL; scheme, query, fragment and slashes at the end are left out."""
    plain = F.rtrim(F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), r"[?#].*$", ""), F.lit("/"))
    host = F.substring_index(plain, "/", 1)
    return F.concat(F.array(F.substring_index(host, ".", -2)), F.split(plain, "/"))


def joined(parts: Column) -> Column:
    return F.array_join(parts, "/")


def prefixes(items: DataFrame, parts: str = "parts") -> DataFrame:
    """Each item once for each prefix of its path: prefix, parent (null for a root), depth, last (the whole path)."""
    cut = items.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
    return cut.withColumns(
        {
            "prefix": joined(F.slice(parts, F.lit(1), F.col("depth"))),
            "parent": F.when(F.col("depth") > 1, joined(F.slice(parts, F.lit(1), F.col("depth") - 1))),
            "last": F.col("depth") == F.size(parts),
        }
    )


def nodes(items: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per prefix: prefix, parent, depth, n (items below it, itself included). One shuffle, no recursion."""
    return prefixes(items, parts).groupBy("prefix", "parent", "depth").agg(F.count("*").alias("n"))


def edges(items: DataFrame, parts: str = "parts") -> DataFrame:
    """Distinct (src, dst) from each prefix to its parent."""
    return nodes(items, parts).where("parent IS NOT NULL").select(F.col("prefix").alias("src"), F.col("parent").alias("dst"))


def single_chains(tree: DataFrame) -> DataFrame:
    """Prefixes whose only child has children of its own, so that a search can go down at once."""
    children = tree.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"), F.max("prefix").alias("child"))
    inner = children.select(F.col("parent").alias("child"))
    return children.where("n_children = 1").join(inner, "child", "left_semi").select(F.col("parent").alias("prefix"), "child")


def chain_ends(tree: DataFrame) -> DataFrame:
    """(prefix, last): where a search that begins at each prefix really begins, at the end of its single chain.

    A prefix that begins no chain ends at itself. No loop: each prefix looks at the prefixes above it, and the chain
    breaks below the deepest that has no single step down.
    """
    inner = tree.select("prefix", "depth")
    steps = single_chains(tree)
    # the deepest ancestor, or the prefix itself, from which there is no step down
    up = ancestors(tree).select("prefix", "ancestor", "depth").union(inner.select("prefix", F.col("prefix").alias("ancestor"), "depth"))
    stepped = up.join(steps.select(F.col("prefix").alias("ancestor"), F.lit(True).alias("goes_on")), "ancestor", "left")
    # y is the end of the chain from x if all from x to above y go on, and y doesn't
    stops = stepped.where("goes_on IS NULL").groupBy("prefix").agg(F.array_sort(F.collect_list("depth")).alias("stops"))
    ends = stops.where(F.element_at("stops", -1) == F.size(F.split("prefix", "/"))).select(F.col("prefix").alias("last"), "stops")
    before = F.when(F.size("stops") > 1, F.element_at("stops", -2)).otherwise(0)
    parts = F.split("last", "/")
    starts = ends.select("last", F.explode(F.sequence(before + 1, F.size(parts))).alias("depth"))
    return starts.select(joined(F.slice(F.split("last", "/"), F.lit(1), F.col("depth"))).alias("prefix"), "last")


def possible_roots(content: DataFrame, sources: DataFrame, tree: DataFrame, ignored: DataFrame, whole: str) -> DataFrame:
    """(prefix): where a search over files begins, free of what is ignored.

    That is ``src`` below the ``content`` roots where there is one, the ``sources``, each without what another covers;
    the ``whole`` if there are none.
    """
    src = content.select(F.concat("prefix", F.lit("/src")).alias("prefix")).join(tree.select("prefix"), "prefix", "left_semi")
    roots = topmost(src.union(sources.select("prefix")).distinct())
    found = propagated_roots(tree, roots, ignored)
    default = tree.sparkSession.createDataFrame([(whole,)], "prefix string")
    none = found.agg(F.count("*").alias("n")).where("n = 0")
    # one row or none
    return found.union(default.join(F.broadcast(none)).select("prefix"))


def ancestors(tree: DataFrame) -> DataFrame:
    """(prefix, ancestor, depth of the ancestor) for each strict ancestor. Rows are bounded by nodes x their depth."""
    cut = tree.select("prefix", F.split("prefix", "/").alias("parts")).where(F.size("parts") > 1)
    cut = cut.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)))
    return cut.select("prefix", joined(F.slice("parts", F.lit(1), F.col("depth"))).alias("ancestor"), "depth")


def nearest(tree: DataFrame, marked: DataFrame) -> DataFrame:
    """(prefix, ancestor): the deepest strict ancestor among ``marked`` (prefix); prefixes without one are left out."""
    known = marked.select(F.col("prefix").alias("ancestor")).distinct()
    return ancestors(tree).join(known, "ancestor").groupBy("prefix").agg(F.max_by("ancestor", "depth").alias("ancestor"))


def topmost(marked: DataFrame) -> DataFrame:
    """``marked`` prefixes with no marked strict ancestor; ``orderBy("prefix", ascending=False)`` visits the last first."""
    known = marked.select(F.col("prefix").alias("ancestor")).distinct()
    below = ancestors(marked).join(known, "ancestor", "left_semi").select("prefix").distinct()
    return marked.join(below, "prefix", "left_anti")


def propagated_roots(tree: DataFrame, roots: DataFrame, ignored: DataFrame) -> DataFrame:
    """The largest subtrees below ``roots`` (prefix) with nothing ignored in them; ``ignored`` (prefix) and below go."""
    barrier = ignored.select("prefix").union(ancestors(ignored).select(F.col("ancestor").alias("prefix"))).distinct()
    up = ancestors(tree).select("prefix", "ancestor").union(tree.select("prefix", F.col("prefix").alias("ancestor")))
    under = up.join(ignored.select(F.col("prefix").alias("ancestor")).distinct(), "ancestor", "left_semi").select("prefix")
    inside = up.join(roots.select(F.col("prefix").alias("ancestor")).distinct(), "ancestor", "left_semi").select("prefix").distinct()
    free = tree.join(inside, "prefix", "left_semi").join(barrier, "prefix", "left_anti").join(under, "prefix", "left_anti")
    whole = free.join(roots.select("prefix").distinct(), "prefix", "left_semi")
    cut = free.join(barrier.withColumnRenamed("prefix", "parent"), "parent", "left_semi")
    return whole.select("prefix").union(cut.select("prefix")).distinct()
