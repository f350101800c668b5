"""What happens inside a search, as events that are written while it goes.

An event is a JSON object with its number, the levels it happened in, and one of these shapes: ``level`` (name, items),
``empty level`` (name), ``run`` (kind, items: how many were retained; verdict), and ``comparison`` (the same, with the
baseline's failure, the one found, and whether they are alike). Events are few: one for each level and each set that was
decided, never for rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareframe.operators.search import NONE, Decided
from pareframe.sources.tables import write_text

EVENT = "number int, levels array<string>, event string, name string, kind string, items long, verdict string, baseline string, found string, same boolean"


class Trace:
    """Writes a file for each event into the folder ``place``, which any file system of Spark's may hold."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place, self.levels, self.n = spark, place, [], 0

    def event(self, event: str, **what) -> None:
        found = {"number": self.n, "levels": list(self.levels), "event": event, **what}
        write_text(self.spark, f"{self.place}/{self.n:06}-{event.replace(' ', '-')}.json", json.dumps(found, default=str))
        self.n += 1

    @contextmanager
    def level(self, name: str, items: int) -> Iterator[None]:
        """A level; events until its end are within it."""
        self.event("level", name=name, items=items)
        self.levels.append(name)
        try:
            yield
        finally:
            self.levels.pop()

    def empty(self, name: str) -> None:
        self.event("empty level", name=name)

    def watch(self, test: Decided) -> Decided:
        """``test``, whose decisions are events from now on. A verdict that comes of comparing failures is a comparison."""

        def decided(entry: dict) -> None:
            told = {"kind": entry["kind"], "items": entry["retained"], "verdict": entry["verdict"]}
            if test.compared is not None and entry["verdict"] != NONE:
                baseline, found = (json.dumps(x, default=str) for x in test.compared)
                self.event("comparison", **told, baseline=baseline, found=found, same=entry["outcome"])
            else:
                self.event("run", **told)

        test.listener = decided
        return test


def read(spark: SparkSession, place: str) -> DataFrame:
    """All events of a trace, a row each."""
    return spark.read.schema(EVENT).json(place)


def totals(events: DataFrame) -> DataFrame:
    """(level, event, verdict, n, items): events by shape, and the items that were retained in them."""
    level = F.coalesce(F.try_element_at("levels", F.lit(-1)), F.col("name"))
    return events.groupBy(level.alias("level"), "event", "verdict").agg(F.count("*").alias("n"), F.sum("items").alias("items"))
