"""Pointer jumping: rows that each name one next row are followed to where their chain ends, in as many rounds as the
logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pareframe.sources.tables import fresh


def jumped(pointers: DataFrame, compose: dict[str, Column] | None = None) -> DataFrame:
    """(id, next, open, ...): where the chain of each of ``pointers`` (id, next, ...) ends: at an id that isn't one of them.

    ``compose`` says what a further column becomes when a row goes on from ``next``: an expression of the column's name,
    for what was gathered so far, and the name with a 2 after it, for what the next row has gathered. Rows whose chain runs
    into a circle never end: they stay ``open``, and have gathered from each row of the circle at least once.
    """
    compose = compose or {}
    known = pointers.select(F.col("id").alias("next"), F.lit(True).alias("open"))
    now = fresh(pointers.join(known, "next", "left").select("id", "next", F.coalesce("open", F.lit(False)).alias("open"), *compose))
    rounds = None
    while (left := now.where("open").count()) and rounds != 0:
        # as many as any chain of them needs
        rounds = (left + 1).bit_length() if rounds is None else rounds - 1
        then = now.select(F.col("id").alias("at"), F.col("next").alias("next2"), F.col("open").alias("open2"), *(F.col(c).alias(f"{c}2") for c in compose))
        moved = now.where("open").join(then, F.col("next") == F.col("at")).select("id", F.col("next2").alias("next"), F.col("open2").alias("open"), *(v.alias(c) for c, v in compose.items()))
        now = fresh(now.where("NOT open").unionByName(moved))
    return now
