"""Comments of source texts, found by a scanner that knows nesting and quotes, and removed by an edit script."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pareframe.operators import edits

#: In code: what is quoted is passed over whole, an unfinished string ends with its line; the other two begin a comment.
CODE = re.compile(r'"""(?s:.*?)(?:"""+|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|//[^\n]*|/\*')
#: In a comment: one more begins, or one ends.
NESTED = re.compile(r"/\*|\*/")
KINDS = ("doc", "block", "line")


def comments(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind (doc, block, line) of each comment, outermost ones only. One without an end goes on to the last
    character. Scanned by two patterns in turn, so time is linear in the text."""
    out, at = [], 0
    while (found := CODE.search(text, at)) is not None:
        at = found.end()
        if found[0].startswith("//"):
            out.append((found.start(), at, "line"))
        elif found[0] == "/*":
            depth, start = 1, found.start()
            while depth:
                mark = NESTED.search(text, at)
                if mark is None:
                    at = len(text)
                    break
                depth += 1 if mark[0] == "/*" else -1
                at = mark.end()
            out.append((start, at, "doc" if text.startswith("/**", start) and not text.startswith("/**/", start) else "block"))
    return out


def found(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(``key``, start, end, kind) of the comments of all texts."""
    kind = T.StructType([texts.schema[key], *T.StructType.fromDDL("start long, end long, kind string")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            rows = [(k, *c) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in comments(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], names=arrow.names)

    return texts.select(key, text).mapInArrow(task, kind)


def without(texts: DataFrame, kinds: tuple[str, ...] = KINDS, key: str = "id", text: str = "text") -> DataFrame:
    """``texts`` with edited: the text without its comments of these kinds; further columns as ``edits.applied`` adds them."""
    script = found(texts, key, text).where(F.col("kind").isin(*kinds))
    return edits.applied(texts, script.select(key, "start", "end", F.lit(None).cast("string").alias("replacement"), F.lit(False).alias("comma")), key, text)
