"""Embedding whitening by a bit-sliced scatter matrix.

Entries are fixed-point whole numbers x = floor(64 * c) + 1,000,000. Of a block of rows, each dimension's numbers less
their minimum are cut into bit planes, and each plane is packed across rows into words of 64 bits. The cross-product of
two dimensions is then a sum over pairs of planes of 2^(a+b) times the popcount of their conjunction, and the minima are
added back in whole numbers. Blocks, tasks and the whole table are summed exactly, so the scatter matrix doesn't depend
on how rows are dealt; it is centred as whole numbers (n * sum(x y) - sum(x) * sum(y)) before it becomes doubles for
``eigh``.

What reaches the driver is a number for each pair of dimensions. A task holds one block, of at most BLOCK entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: Entries of a block of rows.
BLOCK = 1 << 19
#: Doubles beyond hold no fractions; larger entries count as so large.
LARGEST = 2**53


@dataclass(frozen=True)
class Whitening:
    """A fit. ``mean`` is that of x - SHIFT; ``components`` has a unit vector a row, by falling ``variances`` (of x)."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """What a projection is multiplied by; NaN where x doesn't vary, to the precision of doubles."""
        least = max(float(self.variances[0]), 0.0) * len(self.sums) * np.finfo(float).eps if len(self.variances) else 0.0
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.variances > least, 1 / np.sqrt(self.variances), np.nan)


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all of its entries are numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of the vectors, the larger one if two are as frequent; 0 without any."""
    counts = vectors.groupBy(F.size("vector").alias("d")).count()
    most = counts.agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    return most["d"] if most else 0


def fixed(entries: pa.Array, rows: int) -> np.ndarray:
    """x - SHIFT of a list column's values, a row for each vector."""
    doubles = entries.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.clip(np.floor(doubles * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(rows, -1)


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of non-negative numbers (rows, dimensions): their words, dimensions and weights' exponents."""
    rows, width = shifted.shape
    words, of, exponents = [], [], []
    padded = np.zeros((-rows % 64 + rows, width), dtype=np.uint8)
    highest = shifted.max(axis=0, initial=0)
    for bit in range(int(highest.max(initial=0)).bit_length()):
        dims = np.flatnonzero(highest >> bit)
        padded[:rows] = (shifted >> bit) & 1
        packed = np.packbits(np.ascontiguousarray(padded[:, dims].T), axis=1)
        words.append(packed.view(np.uint64))
        of.append(dims)
        exponents.append(np.full(len(dims), bit))
    if not words:
        return np.zeros((0, len(padded) // 64), np.uint64), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(words), np.concatenate(of), np.concatenate(exponents)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the columns of whole numbers, as exact Python integers."""
    rows, width = x.shape
    low = x.min(axis=0)
    words, of, exponents = planes(x - low)
    bits = int(exponents.max(initial=-1)) + 1
    wide = object if 2 * bits + rows.bit_length() + 1 > 62 else np.int64
    cross, sums = np.zeros((width, width), dtype=wide), np.zeros(width, dtype=wide)
    np.add.at(sums, of, np.array([int(c) << int(e) for c, e in zip(np.bitwise_count(words).sum(axis=1), exponents, strict=True)], dtype=wide))
    for i in range(len(words)):
        counts = np.bitwise_count(words[i:] & words[i]).sum(axis=1, dtype=np.int64).astype(wide)
        counts[1:] *= 2  # each pair of planes stands for both orders
        np.add.at(cross[of[i]], of[i:], counts * (1 << exponents[i:].astype(wide)) * (1 << int(exponents[i])))
    # what two orders of one pair gave is split evenly between the halves of the matrix
    both = cross.astype(object) + cross.astype(object).T
    own, low = sums.astype(object), low.astype(object)
    full = both // 2 + np.outer(own, low) + np.outer(low, own) + rows * np.outer(low, low)
    return own + rows * low, full


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK // max(1, width))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def fit(vectors: DataFrame, width: int, count: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (vector: arrays of ``width`` numbers); None without rows or dimensions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own, cross = 0, 0, 0
        for batch in batches:
            for block in _blocks(batch, width):
                s, c = scatter(fixed(block.column("vector").flatten(), block.num_rows))
                n, own, cross = n + block.num_rows, own + s, cross + c
        if n:
            i, j = np.triu_indices(width)
            values = [n, *own, *cross[i, j]]
            totals = pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([-1] + [-1] * width + i.tolist()), pa.array([-1, *range(width), *j.tolist()]), totals], names=["i", "j", "total"])

    if not width:
        return None
    found = vectors.select("vector").mapInArrow(sums, "i long, j long, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    totals = {(r["i"], r["j"]): int(r["total"]) for r in found}
    if not totals:
        return None
    n = totals[-1, -1]
    own = [totals[-1, j] for j in range(width)]
    variance = np.zeros((width, width))
    for (i, j), total in totals.items():
        if i >= 0:
            variance[i, j] = variance[j, i] = (n * total - own[i] * own[j]) / n**2
    values, found = np.linalg.eigh(variance)
    order = np.argsort(values)[::-1][: min(count, width)]
    return Whitening(n, tuple(own), np.array([s / n for s in own]), found[:, order].T.copy(), np.maximum(values[order], 0), float(np.trace(variance)))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The sum over dimensions of (n * x - S)^2, exactly; the shift of x cancels out."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if len(sums) * most**2 < 2**63:
        d = n * x - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


def projections(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows: x less the mean, on each component, over the root of its variance."""
    return (x - model.mean) @ (model.components * model.scales[:, None]).T


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured over all rows.

    Components without variance don't count. Each block is centred by its own mean; the blocks' means are merged after.
    """
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        use = np.flatnonzero(~np.isnan(model.scales))
        total, means = np.zeros((len(use), len(use))), np.zeros(len(use))
        for batch in batches:
            for block in _blocks(batch, len(model.sums)):
                w = projections(fixed(block.column("vector").flatten(), block.num_rows), model)[:, use]
                mean = w.mean(axis=0)
                total += (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)
                means += len(w) * mean
        i, j = np.triu_indices(len(use))
        ids, ones = np.arange(len(use)), np.full(len(use), -1)
        values = [np.concatenate([ones, i]), np.concatenate([ids, j]), np.concatenate([means, total[i, j]])]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["i", "j", "total"])

    found = vectors.select("vector").mapInArrow(moments, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    means = {r["j"]: r["total"] / model.n for r in found if r["i"] < 0}
    rest = (r["total"] / model.n - means[r["i"]] * means[r["j"]] - (r["i"] == r["j"]) for r in found if r["i"] >= 0)
    return max(map(abs, rest), default=0.0)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vectors`` (any columns, vector) with deviation (decimal(38,0)) and whitened (array of doubles, null without variance)."""
    held = vectors.sparkSession.sparkContext.broadcast(model)
    extra = T.StructType.fromDDL("deviation decimal(38,0), whitened array<double>")
    kind = T.StructType(vectors.schema.fields + extra.fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, arrow = held.value, to_arrow_schema(extra)
        for batch in batches:
            for block in _blocks(batch, len(model.sums)):
                x = fixed(block.column("vector").flatten(), block.num_rows)
                deviation = pa.array([Decimal(v) for v in deviations(x, model.n, model.sums)], arrow.field(0).type)
                w = projections(x, model)
                values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([*block.columns, deviation, pa.ListArray.from_arrays(ends, values)], names=[*block.schema.names, *arrow.names])

    return vectors.mapInArrow(task, kind)


def whitening_report(embeddings: DataFrame, vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null, or hold null, NaN or infinite entries, are dropped, and so are those of another length than
    the table's dimension (the most frequent length, the larger of two). Components are numbered from 1 by falling
    variance, equal ones in any order; with fewer than ``count`` dimensions there are as many as these. Where a component
    has no variance (constant dimensions, fewer rows than dimensions) whitened is null and identity_error leaves it out;
    explained is null where nothing varies. Repeated rows and null ids stay, row by row, and count for each. An
    empty table, or empty vectors only, give no rows. A deviation that no long can hold ends in an error of the cast (in
    ANSI mode); ``whiten`` gives it as a decimal. Other columns are not used.
    """
    spark = embeddings.sparkSession
    given = embeddings.select("vec_id", F.col(f"`{vector}`").alias("vector"))
    good = given.where(finite(F.col("vector")))
    width = dimension(good)
    good = good.where(F.size("vector") == width)
    model = fit(good, width, count)
    if model is None:
        kind = T.StructType([embeddings.schema["vec_id"], *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
        return spark.createDataFrame([], kind)
    error = identity_error(good, model)
    shares = [v / model.trace if model.trace else None for v in model.variances.tolist()]
    rows = whiten(good, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(s).cast("double") for s in shares))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )

