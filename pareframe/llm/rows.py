"""Small helpers for functions that run over Arrow batches inside Spark tasks.

Columns of the caller's tables may have any names, also those of columns that an operator adds, or with dots. So
operators work on tables with ``numbered`` columns c0, c1, ..., and give the names back at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a Python function handles at a time. Texts are a few kB on average; this bounds a batch to some MB.
CHUNK = 256


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... in order."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def column(df: DataFrame, name: str) -> str:
    """The numbered name of the column ``name``."""
    return f"c{df.columns.index(name)}"


def named(df: DataFrame, names: list[str], added: list[str] | None = None) -> DataFrame:
    """The numbered columns with their ``names`` again, then those ``added``, which take the place of columns so called."""
    added = added or []
    stay = [i for i, n in enumerate(names) if n not in added]
    return df.select(*(f"c{i}" for i in stay), *added).toDF(*(names[i] for i in stay), *added)


def add_columns(df: DataFrame, reads: dict[str, str], make: Callable[[], Callable[[pa.RecordBatch], list]], added: str, chunk: int = CHUNK) -> DataFrame:
    """``df``, of numbered or other safe names, with the columns ``added``; what it has passes through untouched.

    ``make`` is called once in each task; what it prepares (a matcher, a tokenizer) serves the whole task. It returns a
    function that gets at most ``chunk`` rows of the columns ``reads`` (by the names it knows them by) and returns the
    values of the new columns.
    """
    extra = StructType.fromDDL(added)
    kind = StructType(df.schema.fields + extra.fields)
    names = df.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(extra)
        run = make()
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                given = pa.RecordBatch.from_arrays([part.columns[names.index(c)] for c in reads.values()], names=list(reads))
                new = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(run(given), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *arrow.names])

    return df.mapInArrow(task, kind)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[dict]]], schema: str) -> DataFrame:
    """``df`` through a function of lists of row dictionaries, CHUNK rows at a time; ``make`` as in ``add_columns``.

    For tables whose columns the operator has named itself.
    """
    kind = StructType.fromDDL(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        run = make()
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                yield pa.RecordBatch.from_pylist(run(batch.slice(start, CHUNK).to_pylist()), schema=arrow)

    return df.mapInArrow(task, kind)
