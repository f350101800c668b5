"""Parts of exact set-similarity joins: prefix, length and positional filters, verification, packed columns.

Similarity is Jaccard's: two sets match when ``DEN`` x intersection >= ``NUM`` x union. All tests are on integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pareframe.llm.wordhash import mix

NUM, DEN = 75, 100
#: Ratio of the sizes at the ends of a class of sizes.
CLASS = 1.4


def prefix_size(n: int) -> int:
    """Tokens of a set of ``n``, first in the common order, one of which every match must have."""
    return n - -(-NUM * n // DEN) + 1


def may_match(n1: Column, at1: Column, n2: Column, at2: Column) -> Column:
    """Whether sets of these sizes, whose first common token is at these places, can match.

    Sizes must be near enough, and the tokens from the common one on must suffice for the overlap that is needed.
    """
    near = DEN * F.least(n1, n2) >= NUM * F.greatest(n1, n2)
    needed = F.ceil(NUM * (n1 + n2) / (NUM + DEN))
    return near & (F.least(n1 - at1, n2 - at2) >= needed)


def size_class(n: Column) -> Column:
    """Sizes whose ratio is near ``CLASS``. Sets that match are in the same class or in neighbouring ones: a class is wider than
    DEN / NUM, by more than logarithms are inexact."""
    return F.floor(F.log(n.cast("double")) / math.log(CLASS)).cast("int")


def pack(values: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first: sorted or small numbers then compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeezed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Integers as the smallest type that their span needs: a header, and the array, of which any part can follow it."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if high - low <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + low.to_bytes(8, "little", signed=True), (values.astype(np.int64) - np.int64(low)).astype(kind)


def expand(data: bytes) -> np.ndarray:
    low = np.int64(int.from_bytes(data[1:9], "little", signed=True))
    return np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.int64) + low


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, slice) of each run of equal values."""
    if len(bucket):
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for start, end in zip(np.concatenate([[0], cuts]).tolist(), [*cuts.tolist(), len(bucket)], strict=True):
            yield int(bucket[start]), slice(start, end)


def matching(pairs: DataFrame, sets: DataFrame, ids: tuple[str, ...] = ("sid",)) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets match.

    ``sets`` has the columns ``ids``, n and tokens (sorted 64-bit numbers as bytes). Tokens that are in one set only
    may be left out of them, but n counts all. Where ids are of two columns, those of ``pairs`` are a, a2, b, b2.
    """
    ends = [[f"{x}{i + 1 if i else ''}" for i in range(len(ids))] for x in "ab"]
    first, second = (sets.select(*(F.col(i).alias(e) for i, e in zip(ids, end, strict=True)), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}")) for k, end in enumerate(ends))
    names = ends[0] + ends[1]
    both = pairs.select(*names).join(first, ends[0]).join(second, ends[1]).select(*names, "n0", "n1", "t0", "t1")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *which, n1, n2, t1, t2 = batch.columns
            total = n1.to_numpy().astype(np.int64) + n2.to_numpy()
            shared = common(t1, t2)
            keep = pa.array(DEN * shared >= NUM * (total - shared))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in which], names=names)

    return both.mapInArrow(check, pairs.select(*names).schema)


#: Tokens that are compared in one step.
STEP = 1 << 19


def _tokens(column: pa.Array, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some rows, one after another, and the size of each."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset + rows.start : column.offset + rows.stop + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint64, int(at[-1] - at[0]) // 8, int(at[0])) if data is not None else np.zeros(0, np.uint64)
    return values, np.diff(at) // 8


def _stretches(t1: pa.Array, t2: pa.Array) -> Iterator[slice]:
    """Rows in order, of about STEP tokens or one."""
    sizes = np.cumsum(sum(_tokens(t, slice(0, len(t1)))[1] for t in (t1, t2))) if len(t1) else []
    at = 0
    while at < len(t1):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP, "right")))
        yield slice(at, upto)
        at = upto


def common(t1: pa.Array, t2: pa.Array) -> np.ndarray:
    """Tokens that the two sets of each row share."""
    return np.concatenate([np.zeros(0, np.int64), *(_common(t1, t2, s) for s in _stretches(t1, t2))])


def _common(t1: pa.Array, t2: pa.Array, rows: slice) -> np.ndarray:
    """Tokens that the two sets of each row share, all rows at once: equal tokens of a row meet when sorted."""
    (x, nx), (y, ny) = (_tokens(t, rows) for t in (t1, t2))
    n = rows.stop - rows.start
    row, token = np.concatenate([np.repeat(np.arange(n), nx), np.repeat(np.arange(n), ny)]), np.concatenate([x, y])
    order = np.argsort(mix(token ^ mix(row.astype(np.uint64))))
    row, token = row[order], token[order]
    return np.bincount(row[1:][(row[1:] == row[:-1]) & (token[1:] == token[:-1])], minlength=n)
