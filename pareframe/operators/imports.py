"""Use counts of imports: which imports of a file are used, and how often.

Imports, uses and unresolved names of a file are rows of one table that is dealt out by file once; all that an import is
looked up by are windows inside a file, which need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def parent(path: Column) -> Column:
    """The package of a dotted name; empty for a name without one."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise("")


def short(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def mention(
    path: Column | None = None, name: Column | None = None, alias: Column | None = None, star: Column | None = None,
    imported: Column | None = None, used: Column | None = None, lost: Column | None = None,
) -> Column:
    """A mention as a struct: imported (path, alias, star), used (a declaration's path, and the name) or lost, an unresolved name.

    It may be all of these at once where the import gives that name. What isn't given is null, or false for these three.
    """
    texts = [F.lit(x).cast("string").alias(k) for k, x in (("path", path), ("name", name), ("alias", alias))]
    kinds = [F.coalesce(F.lit(x), F.lit(False)).alias(k) for k, x in (("imported", imported), ("used", used), ("lost", lost))]
    return F.struct(*texts, F.lit(star).cast("boolean").alias("star"), *kinds)


def _within(*by: str) -> WindowSpec:
    return Window.partitionBy("file", *by)


def together(packages: DataFrame, uses: DataFrame, imports: DataFrame | None = None, unresolved: DataFrame | None = None) -> DataFrame:
    """(file, package, path, name, alias, star, imported, used, lost): all mentions with their file's own package, dealt out by file."""
    path, name, yes, no = F.col("path"), F.col("name"), F.lit(True), F.lit(None).cast("string").alias("package")
    rows = packages.select("file", F.col("package").cast("string").alias("package"), mention().alias("m"))
    rows = rows.union(uses.select("file", no, mention(path, name, used=yes)))
    if imports is not None:
        rows = rows.union(imports.select("file", no, mention(path, alias=F.col("alias"), star=F.col("star"), imported=yes)))
    if unresolved is not None:
        rows = rows.union(unresolved.select("file", no, mention(name=name, lost=yes)))
    return rows.select("file", F.max("package").over(_within()).alias("package"), "m.*").where("imported OR used OR lost")


def needing(mentions: DataFrame) -> DataFrame:
    """``mentions`` with scope, the package that is looked in, and needed: whether it is a use that an import must serve.

    Declarations of the file's own package need none, unless they are used by another name than their own. ``mentions``
    has the columns of ``together``; where it is dealt out by file, it isn't shuffled again.
    """
    path, scope = F.col("path"), F.col("scope")
    rows = mentions.where("file IS NOT NULL").withColumn("scope", F.when(F.col("star"), path).otherwise(parent(path)))
    rows = rows.withColumn("used", F.col("used") & path.isNotNull())
    rows = rows.withColumn("foreign", ~scope.eqNullSafe(F.col("package"))).withColumn("renamed", F.col("used") & (F.col("name") != short(path)))
    # in the order of all windows but that by name, so that no other sorts
    rows = rows.drop("package").sortWithinPartitions("file", "scope", "path", "name")
    other = F.coalesce(F.max("renamed").over(_within("scope", "path")), F.lit(False))
    return rows.withColumn("needed", F.col("used") & (F.col("foreign") | other)).drop("foreign", "renamed", "used")


def needing_import(uses: DataFrame, packages: DataFrame) -> DataFrame:
    """(file, path, name, n): uses that an import must serve.

    ``uses`` has (file, path, name), a row for each use of a declaration by a name; ``packages`` has (file, package), a row
    for each file.
    """
    return needing(together(packages, uses)).where("needed").groupBy("file", "path", "name").agg(F.count("*").alias("n"))


def star_demand(needed: DataFrame) -> DataFrame:
    """What ``needing`` gives with demand: uses by package of what isn't imported by name; the root package has none."""
    by_name = F.max(F.col("imported") & ~F.col("star") & F.col("alias").isNull()).over(_within("scope", "path"))
    left = F.col("needed") & ~F.coalesce(F.col("by_name"), F.lit(False)) & (F.col("scope") != "")
    return needed.withColumn("by_name", by_name).withColumn("demand", F.count(F.when(left, 1)).over(_within("scope"))).drop("by_name")


def counted(mentions: DataFrame) -> DataFrame:
    """(file, path, alias, star, n): the imports among ``mentions``, and how often each is used; those that aren't are left out.

    An import counts the uses of its declaration by the name it gives, the unresolved names that are the same, and with a
    star those of its package that no other import serves. ``mentions`` is as for ``needing``.
    """
    star, name = F.col("star"), F.col("name")
    gives = F.when(~star, F.coalesce("alias", short(F.col("path"))))
    rows = needing(mentions.withColumn("name", F.when(F.col("imported"), gives).otherwise(name)))
    rows = star_demand(rows.withColumn("served", F.count(F.when(F.col("needed"), 1)).over(_within("scope", "path", "name"))))
    n = F.when(star, F.col("demand")).when(~star, F.col("served"))
    rows = rows.withColumn("lost", F.col("lost") & name.isNotNull()).where("imported OR lost").withColumn("n", n)
    missing = F.count(F.when(F.col("lost"), 1)).over(_within("name"))
    return rows.withColumn("n", F.col("n") + missing).where("imported AND n > 0").select("file", "path", "alias", "star", "n")


def used_imports(imports: DataFrame, uses: DataFrame, unresolved: DataFrame, packages: DataFrame) -> DataFrame:
    """``imports`` (file, path, alias, star) with n, how often each is used; those that aren't are left out.

    ``uses`` and ``packages`` are as for ``needing_import``; ``unresolved`` has (file, name), a row for each unresolved name.
    """
    return counted(together(packages, uses, imports, unresolved)).select(*imports.columns, "n")


def unused_imports(imports: DataFrame, used: DataFrame) -> DataFrame:
    """The ``imports`` that aren't among the ``used``."""
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("file", "path", "alias", "star")]
    return imports.alias("x").join(used.alias("y"), [same[0], same[1], same[2], same[3]], "left_anti")
