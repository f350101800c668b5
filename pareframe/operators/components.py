"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareframe.sources.tables import PART_ROWS, keep


def _mark(edges: DataFrame) -> tuple:
    """A number that tells edge sets apart; one row reaches the driver."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (src, dst); component is the smallest id reachable.

    Large-star and small-star steps by turns: each hangs neighbours to the smallest one, until every id hangs to
    the smallest of its component. Rounds grow with the logarithm of the longest path. An id in a self-loop only
    is its own component. Edges with a null end are left out; an empty table gives no rows.
    """
    given = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    pairs = given.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = keep(pairs)
    mark = _mark(now)
    now = now.coalesce(mark[0] // PART_ROWS + 1)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # never more edges than before
        now = keep(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), mark[0])
        before, mark = mark, _mark(now)
        if mark == before:
            break
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    loops = given.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component")).distinct()
    alone = loops.join(now.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_anti")
    return leaves.union(roots).union(alone)
