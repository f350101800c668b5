"""Tables of a project's elements: which can be replaced or deleted, what calls them, and where they are.

An element is a row (file, path, kind, lang, has_body, is_constructor, is_operator, in_value_class), ``path`` an array
of names or indexes from the file down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of elements whose bodies can be replaced, and that can be deleted.
REPLACEABLE = ("function", "lambda", "initializer", "accessor", "method")
DELETABLE = ("class", "object", "function", "property", "constructor", "typealias", "parameter")


def replaceable(elements: DataFrame) -> DataFrame:
    """Elements of a replaceable kind with a body; no Java constructors. An unknown body counts as one."""
    java_constructor = (F.col("lang") == "java") & F.coalesce("is_constructor", F.lit(False))
    return elements.where(F.col("kind").isin(*REPLACEABLE) & ~java_constructor & F.coalesce("has_body", F.lit(True)))


def body_items(tables: list[DataFrame]) -> DataFrame:
    """Replaceable elements of all languages with a known place."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return replaceable(out).where("file IS NOT NULL AND path IS NOT NULL")


def removable_parameters(parameters: DataFrame) -> DataFrame:
    """Parameters but those of operators and of constructors of value classes, whose number is fixed."""
    return parameters.where(~F.coalesce("is_operator", F.lit(False)) & ~F.coalesce("in_value_class", F.lit(False)))


def deletable_items(elements: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """Elements of a deletable kind; with ``parameters``, the removable ones, too."""
    out = elements.where(F.col("kind").isin(*DELETABLE))
    return out if parameters is None else out.unionByName(removable_parameters(parameters))


def call_traces(callables: DataFrame, usages: DataFrame) -> DataFrame:
    """``callables`` (callable, ...) with ``traces``: the distinct places that use each, in order; maybe none.

    ``usages`` has (callable, place, in_import). Uses in imports and without a place don't count.
    """
    used = usages.where(~F.coalesce("in_import", F.lit(False)) & F.col("place").isNotNull()).select("callable", "place").distinct()
    traces = used.groupBy("callable").agg(F.array_sort(F.collect_list("place")).alias("traces"))
    none = F.array().cast(traces.schema["traces"].dataType)
    return callables.join(traces, "callable", "left").withColumn("traces", F.coalesce("traces", none))


def matching_parameters(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(function, ordinal, expected, actual): parameters of two declarations of a function, by their place."""
    named = lambda rows, name: rows.select("function", "ordinal", F.col("name").alias(name))
    return named(expected, "expected").join(named(actual, "actual"), ["function", "ordinal"])


def resolved(items: DataFrame, elements: DataFrame) -> DataFrame:
    """``items`` (file, path) with the columns of the element there; those that aren't found are left out."""
    return items.join(elements, ["file", "path"])


def mixed_path(path: Column, is_declaration: Column) -> Column:
    """(stubs, children): the steps up to the first that is no declaration, and from there on."""
    first = F.array_position(is_declaration, False).cast("int")
    n = F.when(first > 0, first - 1).otherwise(F.size(path))
    return F.struct(F.slice(path, F.lit(1), n).alias("stubs"), F.slice(path, n + 1, F.size(path)).alias("children"))


def one_file(items: DataFrame) -> DataFrame:
    """``items``, which must share a file."""
    if items.select("file").distinct().limit(2).count() > 1:
        raise ValueError("items of one tree must be in one file")
    return items


def copied(files: DataFrame, skipped: tuple[str, ...]) -> DataFrame:
    """Files (path) but those in the ``skipped`` folders."""
    inside = F.lit(False)
    for folder in skipped:
        inside = inside | (F.col("path") == folder) | F.startswith("path", F.lit(f"{folder}/"))
    return files.where(~inside)


def tasks_named(tasks: DataFrame, name: Column) -> DataFrame:
    """The tasks (path) that a ``name`` means: itself if it begins with a colon, else any that end with it."""
    return tasks.where(F.when(F.startswith(name, F.lit(":")), F.col("path") == name).otherwise(F.endswith("path", F.concat(F.lit(":"), name))))


def progress(total: int, remaining: int, before: int = 1) -> int:
    """Per cent done, from 1 to 100, that never falls."""
    return max(before, min(100, max(1, 100 * (total - remaining) // total if total else 100)))
