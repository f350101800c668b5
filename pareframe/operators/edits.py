"""Edit scripts: deletions and replacements as intervals of a text, all applied in one sweep.

Offsets count characters, ends are exclusive. A text and its edits are handled in one task; tables of texts are dealt as
they come, and edits meet their texts by one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Edit = tuple[int, int, str, bool]
#: What an edit table has, and what ``applied`` adds: the pieces of the old text that are left, and how far they moved.
EDIT = "start long, end long, replacement string, comma boolean"
ADDED = "edited string, n_edits long, pieces array<struct<old:long,new:long,size:long>>"


def with_commas(text: str, edits: list[Edit]) -> list[Edit]:
    """Sorted edits, those with ``comma`` grown by the comma that separates what they delete from its neighbours.

    That is the next one, with the white space up to what follows; without one, the last before it that isn't gone yet, with
    the white space behind it. So of a list of which all is deleted no comma is left.
    """
    out: list[Edit] = []
    for start, end, new, comma in sorted(edits, key=lambda e: (e[0], -e[1], e[2])):
        if comma:
            at = end
            while at < len(text) and text[at].isspace():
                at += 1
            if at < len(text) and text[at] == ",":
                end = at + 1
                while end < len(text) and text[end].isspace():
                    end += 1
            else:
                at, k = start, len(out) - 1
                while at > 0:
                    while k >= 0 and out[k][0] >= at:
                        k -= 1
                    if k >= 0 and out[k][1] >= at and not out[k][2]:
                        at = out[k][0]  # gone already
                    elif text[at - 1].isspace():
                        at -= 1
                    else:
                        break
                if at > 0 and text[at - 1] == ",":
                    start = at - 1
        out.append((start, end, new, comma))
    return out


def swept(edits: list[Edit]) -> list[tuple[int, int, str]]:
    """Disjoint intervals in order, with what takes their place.

    Of nested edits the outermost stays, of equal ones the one whose replacement comes last. Edits that overlap are one
    interval, with the replacements of its outermost edits in order. Edits that touch stay apart.
    """
    out: list[tuple[int, int, str]] = []
    for start, end, new, _ in sorted(edits, key=lambda e: (e[0], -e[1])):
        if out and end <= out[-1][1] and (start, end) != (out[-1][1],) * 2:
            if (start, end) == out[-1][:2] and new > out[-1][2]:
                out[-1] = (start, end, new)
            continue
        if out and start < out[-1][1]:
            a, _, before = out.pop()
            start, new = a, before + new
        out.append((start, end, new))
    return out


def edited(text: str, edits: list[Edit]) -> tuple[str, int, list[dict]]:
    """The text after all ``edits``, how many intervals changed, and the pieces that are left."""
    inside = [(max(0, a), min(len(text), b), new, comma) for a, b, new, comma in edits if a <= b and b >= 0 and a <= len(text)]
    changes, out, pieces, at, size = swept(with_commas(text, inside)), [], [], 0, 0
    for start, end, new in [*changes, (len(text), len(text), "")]:
        if start > at:
            pieces.append({"old": at, "new": size, "size": start - at})
        out += [text[at:start], new]
        size += start - at + len(new)
        at = end
    return "".join(out), len(changes), pieces


def applied(texts: DataFrame, edits: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``texts`` with edited, n_edits and pieces, by ``edits`` (``key``, start, end, replacement, comma).

    A null replacement deletes. Edits beyond the text are cut to it, those with a null offset or the end before the start
    are ignored. A null text stays null; texts without edits stay as they are.
    """
    known = edits.where("start IS NOT NULL AND end IS NOT NULL")
    one = F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("replacement"), F.coalesce("comma", F.lit(False)).alias("comma"))
    scripts = known.groupBy(F.col(key).alias("__key")).agg(F.collect_list(one).alias("__edits"))
    both = texts.join(scripts, F.col(key) == F.col("__key"), "left").drop("__key")
    extra = T.StructType.fromDDL(ADDED)
    kind, names = T.StructType([*texts.schema.fields, *extra.fields]), texts.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(extra)
        for batch in batches:
            found = []
            for t, script in zip(batch.column(text).to_pylist(), batch.column("__edits").to_pylist(), strict=True):
                edits = [(e["start"], e["end"], e["replacement"], e["comma"]) for e in script or []]
                found.append((None, 0, None) if t is None else edited(t, edits))
            new = [pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["__edits"]).columns, *new], names=[*names, *arrow.names])

    return both.mapInArrow(task, kind)


def moved(pieces: Column, offset: Column) -> Column:
    """Where a place of the old text is in the new one: in what is left, the same place; else where the next piece begins,
    or the last one ends."""
    inside = F.filter(pieces, lambda p: (p["old"] <= offset) & (offset < p["old"] + p["size"]))
    after = F.filter(pieces, lambda p: p["old"] >= offset)
    last = F.try_element_at(pieces, F.lit(-1))
    end = F.when(F.size(pieces) > 0, last["new"] + last["size"]).otherwise(F.lit(0))
    there = F.get(inside, F.lit(0))
    return F.when(F.size(inside) > 0, there["new"] + offset - there["old"]).when(F.size(after) > 0, F.get(after, F.lit(0))["new"]).otherwise(end)
