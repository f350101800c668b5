"""Dependencies of declarations as a multigraph: members along supertypes, and parallel edges told apart by their kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareframe.operators.graph import Rounds
from pareframe.sources.tables import fresh

TREE, FILE, OVERLOAD, OBLIGATORY, USAGE = "tree", "file", "overload", "obligatory", "usage"
EDGE = ("src", "dst", "kind")


def overridden(types: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst): each of ``members`` (id, owner, name) and the members that it overrides, by ``types`` (sub, super).

    Supertypes are looked at upwards on all ways at once. On each way the nearest member of that name is found, and hides
    those above it. A type that is reached on several ways is looked at once; types in a circle end. Rounds grow with
    the longest way without such a member.
    """
    above, declared = fresh(types.where("sub <> super").distinct()), fresh(members.select("id", "owner", "name").distinct())
    step = lambda at: at.join(above, F.col("at") == F.col("sub")).select("id", "name", F.col("super").alias("at")).distinct()
    own = declared.select("id", "name", F.col("owner").alias("at"))
    front = fresh(step(own))
    seen, found = Rounds(front), None
    while not front.isEmpty():
        # a type has a few members of a name, the front's row for it is one
        hits = declared.select(F.col("id").alias("dst"), F.col("owner").alias("at"), "name")
        met = fresh(front.join(hits, ["at", "name"]).select("id", "name", "at", "dst"))
        found = met if found is None else found.union(met)
        on = front.join(met.select("id", "name", "at").distinct(), ["id", "name", "at"], "left_anti")
        front = fresh(step(on).join(seen.all(), ["id", "name", "at"], "left_anti"))
        seen.add(front)
    if found is None:
        return declared.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    return found.where("id <> dst").select(F.col("id").alias("src"), "dst").distinct()


def obligatory(overrides: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst): types and those of their ``members`` (id, owner, abstract) that they can't do without.

    That is a member with a body that overrides an abstract one, or several at once.
    """
    body = members.select(F.col("id").alias("src"), "owner", "abstract").where("NOT abstract")
    over = overrides.join(members.select(F.col("id").alias("dst"), F.col("abstract").alias("above")), "dst")
    needed = over.groupBy("src").agg((F.bool_or("above") | (F.count("*") > 1)).alias("needed")).where("needed")
    return body.join(needed, "src").select(F.col("owner").alias("src"), F.col("src").alias("dst"))


def file_edges(elements: DataFrame) -> DataFrame:
    """(src, dst, kind): each of ``elements`` (id, path) and its file; files and folders and the folder that holds them."""
    inside = elements.select(F.col("id").cast("string").alias("src"), F.col("path").alias("dst"), F.lit(TREE).alias("kind"))
    cut = lambda path: F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")
    whole = elements.select("path").where("path <> ''").distinct()
    ends = whole.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("src"))
    tree = ends.where("src <> ''").distinct().select("src", cut(F.col("src")).alias("dst"), F.lit(FILE).alias("kind"))
    return inside.union(tree)


def multigraph(elements: DataFrame, types: DataFrame, members: DataFrame, usages: DataFrame) -> DataFrame:
    """(src, dst, kind), parallel edges and all: what each declaration needs.

    ``elements`` (id, path, parent: the declaration around it, or null), ``types`` (sub, super), ``members`` (id, owner, name,
    abstract), ``usages`` (src, dst), of which each row is an edge of its own. A type needs its supertypes, a member what it
    overrides, a type what it is obliged to override, everything its file, and files their folder.
    """
    kind = lambda edges, name: edges.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(name).alias("kind"))
    over = fresh(overridden(types, members))
    parents = elements.where("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    supers = types.distinct().select(F.col("sub").alias("src"), F.col("super").alias("dst"))
    parts = [kind(parents, TREE), kind(supers, OVERLOAD), kind(over, OVERLOAD), kind(obligatory(over, members), OBLIGATORY), kind(usages, USAGE), file_edges(elements)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
