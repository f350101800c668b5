"""Diagnostics as columns: parsing, relativising, comparing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What marks an internal failure of the compiler, and the types of its back end.
INTERNAL_ENDS = "Please report this problem https://kotl.in/issue"
BACKEND_TYPES = ("org.jetbrains.kotlin.backend.common.CompilationException", "org.jetbrains.kotlin.backend.common.BackendException")
INTERNAL_STARTS = (*BACKEND_TYPES, "org.jetbrains.kotlin.util.FileAnalysisException")
PROCESSOR_MARK = "[ksp]"
OLD_POSITION = "File being compiled:"
FRAME = "\tat"
INFORMATIVE = "at org.jetbrains.kotlin."
#: Sums of differences over this lose the similarity of stack traces.
SIMILAR = 0.95
#: What may stand before a path that begins a word, and before the path of a file's address.
BEFORE, ADDRESS = "\"'([{<=", "file://"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def split_message(text: Column) -> tuple[Column, Column]:
    """Message and stack: the lines before the first that begins with a tab and "at", and from there on (or null)."""
    lines = F.split(text, "\n", -1)
    first = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit(FRAME))), True).cast("int")
    message = F.array_join(F.when(first > 0, F.slice(lines, F.lit(1), first - 1)).otherwise(lines), "\n")
    stack = F.when(first > 0, F.array_join(F.slice(lines, first, F.size(lines)), "\n"))
    return message, stack


def split_type(text: Column) -> tuple[Column, Column]:
    """Type and rest at the first colon; both null without one."""
    at = F.instr(text, ":")
    return F.when(at > 0, _trim(F.substr(text, F.lit(1), at - 1))), F.when(at > 0, _trim(F.substr(text, at + 1)))


def position(text: Column) -> Column:
    """``file:line:col``, read from the right, so that the file may hold colons; null if it is something else.

    The old form, a file after ``File being compiled:``, has no place in it: line and column are -1.
    """
    part = lambda i: F.regexp_extract(text, r"^(.+):(-?[0-9]+):(-?[0-9]+)$", i)
    number = lambda i: part(i).try_cast("int")
    at = lambda file, line, col: F.struct(file.alias("file"), line.alias("line"), col.alias("col"))
    old = at(F.ltrim(F.substr(text, F.lit(len(OLD_POSITION) + 1))), F.lit(-1), F.lit(-1))
    return F.when(F.startswith(text, F.lit(OLD_POSITION)), old).when(number(2).isNotNull() & number(3).isNotNull(), at(part(1), number(2), number(3)))


def severity(letter: Column) -> Column:
    """e, w, i and anything else."""
    return F.when(letter == "e", "ERROR").when(letter == "w", "WARNING").when(letter == "i", "INFO").otherwise("UNKNOWN")


def is_internal(message: Column) -> Column:
    """Whether the compiler itself failed, by how the message ends or begins."""
    return reduce(lambda x, y: x | F.startswith(message, F.lit(y)), INTERNAL_STARTS, F.endswith(message, F.lit(INTERNAL_ENDS)))


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` (message, description, letter, place) with kind, text, stack, at and severity, by the rules for each kind.

    * ``backend``: an internal failure of a back-end type. Of the description after the type, the first line goes, the
      second is the position, the rest message and stack.
    * ``internal``: another internal failure: message, and a stack if there is one.
    * ``ksp``: by its mark, with message and stack.
    * ``general``: anything else, with the place it came with.

    Rows that lack a part which their kind must have are left out.
    """
    type_, rest = split_type(F.col("description"))
    own = rows.withColumns({"__type": type_, "__rest": rest}).withColumn(
        "kind",
        F.when(is_internal(F.col("message")), F.when(F.col("__type").isin(*BACKEND_TYPES), "backend").otherwise("internal"))
        .when(F.startswith("message", F.lit(PROCESSOR_MARK)), "ksp")
        .otherwise("general"),
    )
    lines = F.split("__rest", "\n", -1)
    later = F.when(F.size(lines) > 2, F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n"))
    body = F.when(F.col("kind") == "backend", later).when(F.col("kind") == "internal", F.col("__rest"))
    body = body.otherwise(F.regexp_replace("message", r"^\[ksp\] ", ""))
    own = own.withColumn("__body", body)
    text, stack = split_message(F.col("__body"))
    place = F.when(F.col("kind") == "backend", position(F.get(lines, F.lit(1)))).when(F.col("kind") == "general", position(F.col("place")))
    own = own.withColumns(
        {
            "text": F.when(F.col("kind") == "general", F.col("message")).otherwise(text),
            "stack": F.when(F.col("kind") != "general", stack),
            "at": place,
            "severity": severity(F.col("letter")),
        }
    )
    whole = (F.col("kind") == "general") | (F.col("kind") == "internal") & F.col("__rest").isNotNull() | F.col("stack").isNotNull()
    whole = whole & ((F.col("kind") != "backend") | F.col("at").isNotNull())
    return own.where(whole).drop("__type", "__rest", "__body")


def reported(rows: DataFrame) -> DataFrame:
    """Parsed rows that say a build failed: errors and unknown ones of the general kind, and all others."""
    return rows.where((F.col("kind") != "general") | F.col("severity").isin("ERROR", "UNKNOWN"))


def relative_path(path: Column, base: Column) -> Column:
    """An absolute path seen from ``base``, at component borders, with ``..`` where it must go up; others stay.

    ``.`` and inner ``..`` of both are taken out first.
    """

    def parts(x: Column) -> Column:
        named = F.filter(F.split(x, "/", -1), lambda p: ~p.isin("", "."))
        up = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.aggregate(named, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", up(out)).otherwise(F.concat(out, F.array(p))))

    def seen(both: Column) -> Column:
        mine, its = both["mine"], both["its"]
        shorter = F.least(F.size(mine), F.size(its))
        same = F.zip_with(F.slice(mine, F.lit(1), shorter), F.slice(its, F.lit(1), shorter), lambda a, b: a == b)
        return _let(F.coalesce(F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1, shorter), lambda common: F.array_join(
            F.concat(F.array_repeat(F.lit(".."), F.size(its) - common), F.slice(mine, common + 1, F.size(mine))), "/"
        ))

    return F.when(F.startswith(path, F.lit("/")), _let(F.struct(parts(path).alias("mine"), parts(base).alias("its")), seen)).otherwise(path)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _relative_word(word: Column, base: Column) -> Column:
    """A word in which a path with a place is seen from ``base``; ``BEFORE`` it, and behind the place, anything may stand."""

    def apart(bare: Column) -> Column:
        scheme = F.when(F.startswith(bare, F.lit(ADDRESS)), F.lit(ADDRESS)).otherwise("")
        head = F.substr(word, F.lit(1), F.char_length(word) - F.char_length(bare))
        return F.struct(F.concat(head, scheme).alias("head"), F.substr(bare, F.char_length(scheme) + 1).alias("body"))

    def placed(w: Column) -> Column:
        # the place ends with the last digit
        digits = F.reverse(F.translate(w["body"], "0123456789", "0" * 10))
        size = F.char_length(w["body"]) - F.instr(digits, "0") + 1
        path = F.substr(w["body"], F.lit(1), size)
        found = F.struct(path.alias("path"), position(path).alias("at"), F.substr(w["body"], size + 1).alias("tail"))
        moved = lambda x: F.concat(w["head"], relative_path(x["at"]["file"], base), F.substr(x["path"], F.char_length(x["at"]["file"]) + 1), x["tail"])
        return F.when(F.startswith(w["body"], F.lit("/")), _let(found, lambda x: F.when(x["at"].isNotNull(), moved(x)).otherwise(word))).otherwise(word)

    return F.when(F.instr(word, "/") > 0, _let(F.ltrim(word, F.lit(BEFORE)), lambda bare: _let(apart(bare), placed))).otherwise(word)


def relative(text: Column, base: Column) -> Column:
    """``text`` in which each path with a place (``/a/b:line:col``, a ``file://`` before it stays) is seen from ``base``.

    A path is within one word: it begins it, but for brackets and quotes, and has no white space.
    """
    words = F.split(text, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)", -1)
    return F.array_join(F.transform(words, lambda w: _relative_word(w, base)), "")


def relativised(rows: DataFrame, base: Column) -> DataFrame:
    """Parsed rows with texts and positions relative to ``base``. Stacks stay."""
    at = F.col("at")
    moved = F.when(at.isNotNull(), F.struct(relative_path(at["file"], base).alias("file"), at["line"].alias("line"), at["col"].alias("col")))
    return rows.withColumns({"text": relative(F.col("text"), base), "at": moved})


def stack_prefix(lines: Column, start: str) -> Column:
    """The lines up to the first that, trimmed, doesn't begin with ``start``; without that start, and trimmed again."""
    plain = F.transform(lines, _trim)
    end = F.array_position(F.transform(plain, lambda x: F.startswith(x, F.lit(start))), False).cast("int")
    kept = F.when(end > 0, F.slice(plain, F.lit(1), end - 1)).otherwise(plain)
    return F.transform(kept, lambda x: _trim(F.substr(x, F.lit(len(start) + 1))))


def difference(a: Column, b: Column) -> Column:
    """Edit distance by the longer length; 0 for two empty texts."""
    return F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.char_length(a), F.char_length(b))), F.lit(0.0))


def similarity(pairs: DataFrame, by: list[str], order: str, a: str, b: str) -> DataFrame:
    """1 less the differences of paired lines, each weighed e^-i by its place i from 1: (by..., similarity, similar)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    weighed = pairs.withColumn("__w", F.exp(-place) * difference(F.col(a), F.col(b)))
    total = 1 - F.sum("__w")
    return weighed.groupBy(*by).agg(F.round(total, 6).alias("similarity"), (total > SIMILAR).alias("similar"))


def lines_similarity(a: Column, b: Column) -> Column:
    """The same for two arrays of lines, as far as the shorter goes."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: difference(x, y))
    return 1 - F.aggregate(F.transform(pairs, lambda d, i: F.exp(-(i + 1)) * d), F.lit(0.0), lambda total, d: total + d)


def telling_lines(row: Column) -> Column:
    """Message, then the informative lines of the stack."""
    stack = F.coalesce(F.split(row["stack"], "\n", -1), F.array().cast("array<string>"))
    return F.concat(F.array(F.coalesce(row["text"], F.lit(""))), stack_prefix(stack, INFORMATIVE))


def equal(x: Column, y: Column) -> Column:
    """Equality of two diagnostics (kind, text, severity, stack, at). Of general ones the position doesn't count."""
    same = lambda *names: reduce(lambda p, q: p & q, [x[n].eqNullSafe(y[n]) for n in names])
    return same("kind", "text", "severity") & ((x["kind"] == "general") | same("stack", "at"))


def alike(x: Column, y: Column) -> Column:
    """Whether two diagnostics are the same failure: general ones by equality, others by the similarity of their lines."""
    general = (x["kind"] == "general") | (y["kind"] == "general")
    return F.when(general, equal(x, y)).otherwise(lines_similarity(telling_lines(x), telling_lines(y)) > SIMILAR)


#: What is compared of a diagnostic.
COMPARED = ("kind", "text", "severity", "stack", "at")


def same_failures(first: DataFrame, second: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by..., same): whether the two lists of diagnostics of each key are the same failure.

    There must be the same number on both sides, and those at the same place must be ``alike``. A list that is on one
    side only is the same as none.
    """

    def placed(rows: DataFrame, name: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.select(*by, at.alias("__i"), F.struct(*COMPARED).alias(name))

    both = placed(first, "x").join(placed(second, "y"), [*by, "__i"], "full")
    same = F.coalesce(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), alike(F.col("x"), F.col("y"))), F.lit(False))
    return both.groupBy(*by).agg(F.bool_and(same).alias("same"))


def chain(df: DataFrame, *transformers) -> DataFrame:
    """``df`` through transformers in order."""
    return reduce(lambda x, f: x.transform(f), transformers, df)
