"""Delta debugging over rows: find a small subset of items for which a property still holds.

Items are rows of a DataFrame, numbered by a dense ``idx``. What a search holds on the driver is a list of index
ranges, and of the last LOCAL items what they contribute. A property says of any subset whether it holds:

* ``Property``: a predicate over sums. Every item has a few contributions, and a subset is decided from the sums of its
  items' contributions, so all chunks of a pass are tested by one Spark job; the complement of a chunk has the total
  less the chunk's sums. Once at most LOCAL items are left, their contributions are summed on the driver.
* ``Merged``: a predicate over states that can be merged but not taken apart again (least, most, distinct values). One
  job gives the states of all chunks of a pass; those of the complements are merged from what is before and after a chunk.
* ``Surviving``: the same where rows depend on several items and go with any of them, as in a graph.
* ``Grouped``: a query that can be run for many candidates at once, named by a column ``candidate``.
* ``Tested``: any function of the DataFrames of retained and deleted items, such as a query that is run on what is
  retained. Candidates are tried in order, a run for each.

A search asks ``first`` which of a pass's candidates is the first to have the property.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pareframe.sources.tables import keep

#: Items whose contributions are held on the driver.
LOCAL = 10_000
#: Complements that are tested in one run.
BATCH = 16
#: Outcomes of a test: only the first counts as having the property.
SAME, NONE, OTHER = "property", "no property", "unknown property"

Ranges = tuple[tuple[int, int], ...]


class NoFailure(ValueError):
    """The property doesn't hold for all items together, so there is nothing to look for."""


def numbered(items: DataFrame, *order: str) -> DataFrame:
    """``items`` with a dense ``idx`` from 0 in the given order, computed without a single-partition sort."""
    return numbered_and_counted(items, *order)[0]


def numbered_and_counted(items: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``numbered``, and how many there are.

    Sorted partitions are counted first; each row's number is its place in the partition plus the rows before it.
    """
    ordered = keep(items.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    starts, total = [], 0
    for r in ordered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__part").collect():
        starts.append((r["__part"], total - r["first"]))
        total += r.n
    # a row for each partition
    shift = items.sparkSession.createDataFrame(starts, "__part int, __shift long")
    return ordered.join(F.broadcast(shift), "__part").select(*items.columns, (F.col("__at") + F.col("__shift")).alias("idx")), total


def size(ranges: Ranges) -> int:
    return sum(b - a for a, b in ranges)


def chunks(ranges: Ranges, n: int) -> list[Ranges]:
    """``n`` consecutive parts whose sizes differ by one at most."""
    total = size(ranges)
    cuts = [total * i // n for i in range(n + 1)]
    out: list[Ranges] = []
    at, before = 0, 0
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = []
        # ranges are met in order; the one that a cut goes through is met again
        while at < len(ranges):
            a, b = ranges[at]
            s, e = max(lo, before), min(hi, before + b - a)
            if s < e:
                part.append((a + s - before, a + e - before))
            if before + b - a > hi:
                break
            before, at = before + b - a, at + 1
        out.append(tuple(part))
    return out


def without(ranges: Ranges, gone: Ranges) -> Ranges:
    """Ranges that are in the first and not in the second; both sorted."""
    out, at = [], 0
    for a, b in ranges:
        while at < len(gone) and gone[at][1] <= a:
            at += 1
        k = at
        while k < len(gone) and gone[k][0] < b:
            if a < gone[k][0]:
                out.append((a, gone[k][0]))
            a = max(a, gone[k][1])
            k += 1
        if a < b:
            out.append((a, b))
    return tuple(out)


def merged(indexes: list[int]) -> Ranges:
    """Sorted indexes as ranges."""
    return joined([(i, i + 1) for i in indexes])


def joined(ranges: list[tuple[int, int]]) -> Ranges:
    """Sorted ranges, those that touch as one."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return tuple(map(tuple, out))


@lru_cache(maxsize=1 << 16)
def _mark(i: int) -> int:
    return int.from_bytes(hashlib.blake2b(i.to_bytes(8, "little"), digest_size=16).digest(), "little")


def key(ranges: Ranges) -> int:
    """A number of 128 bits for a set, however it is cut into ranges: that of a set less a subset is the difference."""
    return sum(_mark(b) - _mark(a) for a, b in ranges) % (1 << 128)


def rows_of(items: DataFrame, ranges: Ranges) -> DataFrame:
    """The ``items`` of the ranges."""
    if not ranges:
        return items.limit(0)
    inside = items.where(F.col("idx").between(ranges[0][0], ranges[-1][1] - 1))
    if len(ranges) == 1:
        return inside
    bounds = items.sparkSession.createDataFrame([(a, b - 1) for a, b in ranges], "a long, b long")
    return inside.join(bounds.select(F.explode(F.sequence("a", "b")).alias("idx")), "idx", "left_semi")


def labelled(rows: DataFrame, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> DataFrame:
    """``rows`` (idx first) with the ``part`` whose range they are in, in place of idx; others go. Ranges are sorted."""
    kind = T.StructType([T.StructField("part", T.LongType()), *rows.schema.fields[1:]])
    inside = rows.where(F.col("idx").between(int(starts[0]), int(ends[-1]) - 1))

    def task(batches):
        for batch in batches:
            idx = batch.columns[0].to_numpy()
            at = np.searchsorted(starts, idx, "right") - 1
            hit = (at >= 0) & (idx < ends[at])
            part = pa.array(owner[at[hit]], pa.int64())
            yield pa.RecordBatch.from_arrays([part, *(c.filter(pa.array(hit)) for c in batch.columns[1:])], names=["part", *batch.schema.names[1:]])

    return inside.mapInArrow(task, kind)


def bounds_of(parts: list[Ranges]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted starts and ends of all ranges, and the part of each."""
    bounds = sorted((a, b, i) for i, part in enumerate(parts) for a, b in part)
    return tuple(np.array([x[k] for x in bounds], dtype=np.int64) for k in range(3))


class Decided:
    """What the kinds of properties share: each set is decided once; ``log`` has an entry for each decision.

    A ``listener`` is called with each entry as it comes; ``compared`` then has the failures, or states, of the whole and of
    the retained items, where these were compared.
    """

    listener: Callable[[dict], None] | None = None
    compared: tuple | None = None

    def __init__(self, n: int):
        self.n, self.log, self.memo = n, [], {}

    def require(self) -> Ranges:
        """All items as ranges, if the property holds for them."""
        everything = ((0, self.n),) if self.n else ()
        if self.first("baseline", everything, [everything], complement=False) is None:
            raise NoFailure("the property does not hold for all items")
        return everything

    def first(self, kind: str, now: Ranges, parts: list[Ranges], complement: bool) -> int | None:
        """The first of ``parts`` that has the property alone, or with ``complement`` without which ``now`` has it."""
        whole, total = key(now), size(now)
        for i, part in enumerate(parts):
            name = (whole - key(part)) % (1 << 128) if complement else key(part)
            if name not in self.memo:
                outcome = self._outcome(now, parts, i, complement)
                self.memo[name] = outcome == SAME
                self.log.append({"kind": kind, "retained": total - size(part) if complement else size(part), "outcome": self.memo[name], "verdict": outcome})
                if self.listener is not None:
                    self.listener(self.log[-1])
            if self.memo[name]:
                return i
        return None

    def _outcome(self, now: Ranges, parts: list[Ranges], i: int, complement: bool) -> str:
        raise NotImplementedError


class Property(Decided):
    """``holds`` decides from sums of ``sums`` (columns of ``items``) whether a subset still has the property."""

    def __init__(self, items: DataFrame, sums: dict[str, Column], holds: Callable[[dict[str, float]], bool]):
        self.sums, self.holds = list(sums), holds
        rows = items.select("idx", *(c.alias(k) for k, c in sums.items()))
        if inexact := [f.name for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]:
            raise ValueError(f"sums must not depend on the order of rows: make decimals of {inexact}")
        found = rows.agg(F.count("*").alias("__n"), *(F.sum(k).alias(k) for k in self.sums)).first().asDict()
        super().__init__(found.pop("__n"))
        # few rows are read once more only
        self.rows = rows if self.n <= LOCAL else keep(rows)
        self.total = {k: v or 0 for k, v in found.items()}
        self.known = {key(((0, self.n),) if self.n else ()): self.total}
        self.pass_of, self.values, self.near = None, [], None

    def measure(self, parts: list[Ranges], now: Ranges) -> list[dict[str, float]]:
        """Sums of each part of ``now``, from one job, or from what is on the driver. The parts must not overlap."""
        bounds = sorted((a, b, i) for i, part in enumerate(parts) for a, b in part)
        if not bounds or not self.sums:
            return [dict.fromkeys(self.sums, 0) for _ in parts]
        starts, ends = np.array([x[0] for x in bounds]), np.array([x[1] for x in bounds])
        owner, out = np.array([x[2] for x in bounds]), {k: [0] * len(parts) for k in self.sums}
        if self.near is None and size(now) <= LOCAL:
            # at most LOCAL rows; later sets are parts of this one
            found = rows_of(self.rows, now).orderBy("idx").toArrow().to_pydict()
            self.near = np.array(found["idx"], dtype=np.int64), {k: [0, *accumulate(x or 0 for x in found[k])] for k in self.sums}
        if self.near is not None:
            idx, before = self.near
            low, high = np.searchsorted(idx, starts), np.searchsorted(idx, ends)
            for k in self.sums:
                for i, a, b in zip(owner.tolist(), low.tolist(), high.tolist(), strict=True):
                    out[k][i] += before[k][b] - before[k][a]
        else:
            for r in self._sums_of(starts, ends, owner).collect():
                for k in self.sums:
                    out[k][r.part] += r[k] or 0
        return [{k: out[k][i] for k in self.sums} for i in range(len(parts))]

    def _sums_of(self, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> DataFrame:
        """(part, sums): rows find their range in the sorted bounds, and are summed where they are."""
        return labelled(self.rows, starts, ends, owner).groupBy("part").agg(*(F.sum(k).alias(k) for k in self.sums))

    def _outcome(self, now: Ranges, parts: list[Ranges], i: int, complement: bool) -> str:
        if self.pass_of is not parts:
            self.pass_of = parts
            self.values = [self.known[key(now)]] if parts == [now] and key(now) in self.known else self.measure(parts, now)
            if key(now) not in self.known:
                covered = sum(map(size, parts)) == size(now)
                self.known[key(now)] = {k: sum(v[k] for v in self.values) for k in self.sums} if covered else self.measure([now], now)[0]
        value, whole = self.values[i], self.known[key(now)]
        if complement:
            value = {k: whole[k] - value[k] for k in self.sums}
        if self.holds(value):
            # what a search goes on with
            self.known[(key(now) - key(parts[i])) % (1 << 128) if complement else key(parts[i])] = value
            return SAME
        return NONE


class Tested(Decided):
    """``test`` decides from the DataFrames of retained and deleted ``items``: a bool, or one of SAME, NONE and OTHER."""

    def __init__(self, items: DataFrame, test: Callable[[DataFrame, DataFrame], bool | str]):
        self.items, self.test = keep(items), test
        super().__init__(self.items.count())

    def _outcome(self, now: Ranges, parts: list[Ranges], i: int, complement: bool) -> str:
        retained = without(now, parts[i]) if complement else parts[i]
        deleted = without(((0, self.n),) if self.n else (), retained)
        found = self.test(rows_of(self.items, retained), rows_of(self.items, deleted))
        return found if isinstance(found, str) else SAME if found else NONE


def _order(value):
    """A key that orders Python values as Spark does: null first, NaN last, structs by their fields."""
    if value is None:
        return (0,)
    if isinstance(value, float) and value != value:
        return (2,)
    return (1, tuple(map(_order, value)) if isinstance(value, (tuple, list)) else value)


@dataclass(frozen=True)
class Partial:
    """A state of rows: ``aggregate`` of ``column``. ``merge`` makes one of several, none of them null."""

    column: Column
    aggregate: Callable[[Column], Column]
    merge: Callable[[list], object]

    def all(self, states: list) -> object:
        known = [x for x in states if x is not None]
        return self.merge(known) if len(known) > 1 else known[0] if known else None


def least(column: Column) -> Partial:
    return Partial(column, F.min, lambda x: min(x, key=_order))


def most(column: Column) -> Partial:
    return Partial(column, F.max, lambda x: max(x, key=_order))


def distinct(column: Column) -> Partial:
    """The set of values, of which there must be few: a state has them all."""
    return Partial(column, lambda c: F.array_sort(F.collect_set(c)), lambda x: sorted(set().union(*x), key=_order))


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, tuple) else value


class Merged(Decided):
    """``holds`` decides from merged ``states`` of the retained items: a bool, or one of SAME, NONE and OTHER.

    A pass takes one job, whose result is a state for each chunk. Once at most LOCAL items are left, their own states
    are on the driver and no more jobs are run. A state of no items is None.
    """

    def __init__(self, items: DataFrame, states: dict[str, Partial], holds: Callable[[dict], bool | str]):
        self.states, self.holds = states, holds
        rows = items.select("idx", *(p.column.alias(k) for k, p in states.items()))
        super().__init__(items.count())
        self.rows, self.near = rows, None
        self.pass_of, self.own, self.around = None, [], []
        if self.n <= LOCAL:
            self.total = self.measure([((0, self.n),) if self.n else ()])[0]
        else:
            self.rows = keep(rows)
            found = self.rows.agg(*self._aggregates()).first()
            self.total = {k: plain(found[k]) for k in states}

    def _aggregates(self) -> list[Column]:
        return [p.aggregate(F.col(k)).alias(k) for k, p in self.states.items()]

    def _merge(self, found: list[dict]) -> dict:
        return {k: p.all([x[k] for x in found]) for k, p in self.states.items()}

    def measure(self, parts: list[Ranges]) -> list[dict]:
        """The state of each part, from one job, or from what is on the driver. The parts must not overlap."""
        out = [dict.fromkeys(self.states) for _ in parts]
        starts, ends, owner = bounds_of(parts)
        if not len(starts):
            return out
        if self.near is None and sum(map(size, parts)) <= LOCAL:
            # at most LOCAL rows; later sets are parts of this one
            rows = rows_of(self.rows, joined(sorted(r for p in parts for r in p))).groupBy("idx").agg(*self._aggregates()).orderBy("idx").collect()
            self.near = np.array([x["idx"] for x in rows], dtype=np.int64), [{k: plain(x[k]) for k in self.states} for x in rows]
        if self.near is not None:
            idx, states = self.near
            mine: list[list[dict]] = [[] for _ in parts]
            for a, b, i in zip(np.searchsorted(idx, starts), np.searchsorted(idx, ends), owner.tolist(), strict=True):
                mine[i] += states[a:b]
            return [self._merge(x) for x in mine]
        for x in labelled(self.rows, starts, ends, owner).groupBy("part").agg(*self._aggregates()).collect():
            out[x["part"]] = {k: plain(x[k]) for k in self.states}
        return out

    def _outcome(self, now: Ranges, parts: list[Ranges], i: int, complement: bool) -> str:
        if self.pass_of is not parts:
            rest = without(now, joined(sorted(r for p in parts for r in p)))
            *self.own, other = [self.total, dict.fromkeys(self.states)] if parts == [now] and size(now) == self.n else self.measure([*parts, rest])
            # what is merged before each part, and after it
            before = list(accumulate(self.own, lambda x, y: self._merge([x, y]), initial=other))[:-1]
            after = list(accumulate(reversed(self.own), lambda x, y: self._merge([y, x]), initial=dict.fromkeys(self.states)))[-2::-1]
            self.around = [self._merge([x, y]) for x, y in zip(before, after, strict=True)]
            self.pass_of = parts
        found = self.holds(self.around[i] if complement else self.own[i])
        return found if isinstance(found, str) else SAME if found else NONE


def same_state(items: DataFrame, states: dict[str, Partial], similar: Callable[[dict, dict], bool] = lambda a, b: a == b) -> Merged:
    """The property "the states are like those of the whole"; as ``same_failure`` where a failure is such states.

    A retained set without any state is NONE, one that isn't ``similar`` OTHER.
    """
    test = Merged(items, states, lambda found: True)
    test.baseline = test.total
    if not any(v is not None for v in test.total.values()):
        raise NoFailure("there is no state to begin with")

    def holds(found: dict) -> str:
        test.compared = test.baseline, found
        return NONE if all(v is None for v in found.values()) else SAME if similar(test.baseline, found) else OTHER

    test.holds = holds
    return test


class Surviving(Decided):
    """As ``Merged``, of rows that depend on several of ``n`` items and are there as long as all of these are retained.

    A set is decided without a job. ``groups`` are the rows by what they depend on: the items' idx, and their merged states. They are on the driver, so
    there must be few; ``reduction.graph_reduction`` counts them first.
    """

    def __init__(self, n: int, groups: list[tuple[list[int], dict]], states: dict[str, Partial], holds: Callable[[dict], bool | str]):
        super().__init__(n)
        self.states, self.holds, self.found = states, holds, [state for _, state in groups]
        self.needs = np.array([i for needs, _ in groups for i in needs], dtype=np.int64)
        self.of = np.repeat(np.arange(len(groups)), [len(needs) for needs, _ in groups])

    def _outcome(self, now: Ranges, parts: list[Ranges], i: int, complement: bool) -> str:
        starts, ends, _ = bounds_of([without(now, parts[i]) if complement else parts[i]])
        there = np.zeros(len(self.needs), dtype=bool)
        if len(starts):
            at = np.searchsorted(starts, self.needs, "right") - 1
            there = (at >= 0) & (self.needs < ends[at])
        gone = set(self.of[~there].tolist())
        left = [state for k, state in enumerate(self.found) if k not in gone]
        found = self.holds({k: p.all([x[k] for x in left]) for k, p in self.states.items()})
        return found if isinstance(found, str) else SAME if found else NONE


class Grouped(Decided):
    """The property of a query that is run for many candidates in one go.

    ``run`` gets rows of ``items`` with a column ``candidate``, a row once for each candidate that retains it, and returns
    (candidate, ...), at most one row for each. ``judge`` makes an outcome of such a row, or of None where there is none.
    Chunks of a pass share no rows, so all of them are one run; of complements BATCH are, since each has nearly all rows.
    """

    def __init__(self, items: DataFrame, run: Callable[[DataFrame], DataFrame], judge: Callable[[dict | None], bool | str]):
        order = ["idx", *(c for c in items.columns if c != "idx")]
        self.items, self.run, self.judge = keep(items.select(order)), run, judge
        super().__init__(self.items.count())
        self.pass_of, self.outcomes = None, {}

    def _candidates(self, now: Ranges, parts: list[Ranges], asked: list[int], complement: bool) -> DataFrame:
        rest = joined(sorted(r for p in parts for r in p))
        rows = labelled(self.items.withColumn("row", F.struct("*")).select("idx", "row"), *bounds_of([*parts, without(now, rest)]))
        ids = F.array(*(F.lit(i).cast("long") for i in asked))
        if complement:
            return rows.select("row.*", F.explode(F.filter(ids, lambda c: c != F.col("part"))).alias("candidate"))
        return rows.where(F.array_contains(ids, F.col("part"))).select("row.*", F.col("part").alias("candidate"))

    def _outcome(self, now: Ranges, parts: list[Ranges], i: int, complement: bool) -> str:
        if self.pass_of != (id(parts), complement):
            # a list is kept by its pass, so that no other one has its id
            self.pass_of, self.parts, self.outcomes = (id(parts), complement), parts, {}
        if i not in self.outcomes:
            asked = list(range(i, min(len(parts), i + BATCH) if complement else len(parts)))
            found = {r["candidate"]: r.asDict() for r in self.run(self._candidates(now, parts, asked, complement)).collect()} if now else {}
            for k in asked:
                told = self.judge(found.get(k))
                self.outcomes[k] = told if isinstance(told, str) else SAME if told else NONE
        return self.outcomes[i]


def same_failure(items: DataFrame, run: Callable[[DataFrame], object], similar: Callable[[object, object], bool]) -> Tested:
    """The property "fails like the whole does". ``run`` returns a failure, or None where it succeeds.

    The failure of all items is taken first and is the baseline; without one there is nothing to look for. A success is
    NONE, a failure that isn't ``similar`` to the baseline OTHER.
    """
    baseline = run(items)
    if baseline is None:
        raise NoFailure("there is no failure to begin with")

    def test(retained: DataFrame, deleted: DataFrame) -> str:
        found = run(retained)
        out.compared = baseline, found
        return NONE if found is None else SAME if similar(baseline, found) else OTHER

    out = Tested(items, test)
    out.baseline = baseline
    return out


def emptied(test: Decided, now: Ranges) -> Ranges:
    """``now``, or nothing if it is one item and the property holds without it, too."""
    return () if size(now) == 1 and test.first("empty", now, [now], complement=True) == 0 else now


def ddmin(test: Decided, zero: bool = False) -> Ranges:
    """A 1-minimal subset: taking out any one item, or any chunk tried, loses the property.

    Begins with two chunks. A chunk that has the property alone is taken, again with two chunks; else a chunk
    without which the rest has it is dropped, with one chunk fewer; else there are twice as many chunks. With
    ``zero``, the empty set is tried when one item is left.
    """
    now, n = test.require(), 2
    while size(now) > 1:
        n = min(n, size(now))
        parts = chunks(now, n)
        if (at := test.first("chunk", now, parts, complement=False)) is not None:
            now, n = parts[at], 2
            continue
        if n > 2 and (at := test.first("complement", now, parts, complement=True)) is not None:
            now, n = without(now, parts[at]), n - 1
            continue
        if n == size(now):
            break
        n *= 2
    return emptied(test, now) if zero else now


def initial_probability(n: int) -> float:
    """Of being essential, when two of ``n`` items are expected to be."""
    return min(2 / n if n > 0 else 1.0, 2 / 3)


#: Items of one probability, in order.
Alike = tuple[float, list[tuple[int, int]]]


def _ordered(groups: list[Alike]) -> list[Alike]:
    """By descending probability, ties as they come; neighbours of one probability as one."""
    out: list[Alike] = []
    for p, runs in sorted(groups, key=lambda g: -g[0]):
        if out and out[-1][0] == p:
            out[-1] = (p, [*out[-1][1], *runs])
        else:
            out.append((p, runs))
    return out


def _split(runs: list[tuple[int, int]], n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """All but the last ``n`` items, and these."""
    left, out = list(runs), []
    while n:
        a, b = left.pop()
        take = min(n, b - a)
        out.insert(0, (b - take, b))
        if take < b - a:
            left.append((a, b - take))
        n -= take
    return left, out


def pdd(test: Decided, important: Ranges | None = None, zero: bool = False) -> Ranges:
    """Probabilistic delta debugging: the least likely items are left out together, as many as gain most.

    Each item has a probability of being essential. Items are in descending order of it, ties by index; the suffix
    to leave out grows while size x probability that none of it is essential doesn't fall, and leaves one item at
    least. If the property holds without it, it goes; if not, its items become likelier. ``important`` items begin with
    a probability of their own. The driver holds ranges of items of one probability. ``zero`` as for ddmin.
    """
    everything = test.require()
    hinted = important or ()
    groups: list[Alike] = []
    for ranges in (hinted, without(everything, hinted)):
        if ranges:
            groups.append((initial_probability(size(hinted) if ranges is hinted else test.n), list(ranges)))
    groups, now = _ordered(groups), everything
    while size(now) > 1 and groups[-1][0] < 1:
        left, out, chance, n = list(groups), [], 1.0, 0
        while left:
            p, runs = left[-1]
            # one more pays as long as (n + 1) x (1 - p) >= n
            most = size(runs) if p <= 0 else int((1 - p) / p) + 1 - n
            take = min(size(runs), most, size(now) - 1 - n)
            if take <= 0:
                break
            rest, gone = _split(runs, take)
            out.insert(0, (p, gone))
            chance, n = chance * (1 - p) ** take, n + take
            left = left[:-1] + ([(p, rest)] if rest else [])
            if rest:
                break
        if not out:
            # nothing pays, so the least likely item is asked for alone
            p, runs = left[-1]
            rest, gone = _split(runs, 1)
            out, chance, left = [(p, gone)], 1 - p, left[:-1] + ([(p, rest)] if rest else [])
        gone = joined(sorted(r for _, runs in out for r in runs))
        if test.first("suffix", now, [gone], complement=True) == 0:
            groups, now = left, without(now, gone)
            continue
        likelier = [(min(1.0, p / (1 - chance)) if chance < 1 else 1.0, runs) for p, runs in out]
        groups = _ordered([*left, *likelier])
    return emptied(test, now) if zero else now


def retained(items: DataFrame, ranges: Ranges) -> DataFrame:
    """``items`` with a column ``retained``."""
    bounds = [(a, b - 1) for a, b in ranges]
    kept = items.sparkSession.createDataFrame(bounds, "a long, b long").select(F.explode(F.sequence("a", "b")).alias("idx"), F.lit(True).alias("retained"))
    return items.join(kept, "idx", "left").withColumn("retained", F.coalesce("retained", F.lit(False)))
