"""Arguments of calls: which parameter each is for, and calls without a parameter.

A call is a text such as ``f(1, y = g(2, "a,b")) { it }``. Commas inside brackets, strings and characters don't
separate. Positional arguments take parameters in order, named ones the parameter they name, a block behind the
call the last parameter; what is left out has no entry. An argument beyond the parameters has null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pareframe.operators import edits

OPEN, CLOSE = "([{", ")]}"
#: A string, raw or not, or a character; an unfinished one goes on to the end.
QUOTED = re.compile(r'"""(?s:.*?)(?:"""|\Z)|"(?:\\(?s:.)|[^"\\])*(?:"|\Z)|\'(?:\\(?s:.)|[^\'\\])*(?:\'|\Z)')
NAMED = re.compile(r"\s*([^\W\d]\w*|`[^`]+`)\s*=(?!=)\s*")
FOUND = "arguments array<struct<parameter:string,start:long,end:long,block:boolean>>"


def parts(call: str) -> list[tuple[int, int, bool]]:
    """Start and end of each argument, and whether it is the block behind the brackets."""
    out, depth, at, begin = [], 0, 0, 0

    def add(end: int) -> None:
        text = call[begin:end]
        if text.strip():
            out.append((begin + len(text) - len(text.lstrip()), begin + len(text.rstrip()), False))

    while at < len(call):
        if (quoted := QUOTED.match(call, at)) is not None:
            at = quoted.end()
            continue
        c = call[at]
        if c in OPEN:
            if depth == 0 and c == "{":
                # the block goes on to the end of the call
                return [*out, (at, len(call.rstrip()), True)]
            depth += 1
            if depth == 1:
                begin = at + 1
        elif c in CLOSE and depth:
            if depth == 1:
                add(at)
            depth -= 1
        elif c == "," and depth == 1:
            add(at)
            begin = at + 1
        at += 1
    return out


def assigned(call: str, parameters: list[str]) -> list[dict]:
    """The arguments of a call in order, each with its parameter."""
    out, place = [], 0
    for start, end, block in parts(call):
        name = None if block else NAMED.match(call, start, end)
        if block:
            parameter = parameters[-1] if parameters else None
        elif name:
            parameter = name[1].strip("`")
            place = parameters.index(parameter) + 1 if parameter in parameters else place
        else:
            parameter = parameters[place] if place < len(parameters) else None
            place += 1
        out.append({"parameter": parameter, "start": start, "end": end, "block": block})
    return out


def matched(calls: DataFrame, call: str = "call", parameters: str = "parameters") -> DataFrame:
    """``calls`` with arguments: (parameter, start, end, block) of each, in order. Null calls have none."""
    extra = T.StructType.fromDDL(FOUND)
    kind = T.StructType([*calls.schema.fields, *extra.fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(extra)
        for batch in batches:
            given = zip(batch.column(call).to_pylist(), batch.column(parameters).to_pylist(), strict=True)
            found = [None if text is None else assigned(text, names or []) for text, names in given]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow.field(0).type)], names=[*batch.schema.names, *arrow.names])

    return calls.mapInArrow(task, kind)


def without_parameter(calls: DataFrame, dropped: DataFrame, key: str = "id", call: str = "call") -> DataFrame:
    """``calls`` (with arguments) after parameters are ``dropped`` (``key``, parameter): edited, and the arguments left.

    The argument goes with the comma that separates it. The arguments' parameters are kept up, their places aren't: they are
    those of the old text, and ``pieces`` says where these are now.
    """
    rows = calls.select(key, F.explode("arguments").alias("a")).select(key, "a.*")
    gone = rows.join(dropped.distinct(), [key, "parameter"], "left_semi")
    script = gone.select(key, "start", "end", F.lit(None).cast("string").alias("replacement"), (~F.col("block")).alias("comma"))
    names = dropped.groupBy(F.col(key).alias("__key")).agg(F.collect_set("parameter").alias("__gone"))
    left = F.filter("arguments", lambda a: ~F.coalesce(F.array_contains(F.coalesce("__gone", F.array().cast("array<string>")), a["parameter"]), F.lit(False)))
    found = edits.applied(calls, script, key, call)
    return found.join(names, F.col(key) == F.col("__key"), "left").withColumn("arguments", left).drop("__key", "__gone")
