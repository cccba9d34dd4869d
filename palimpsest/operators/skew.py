"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import Scratch

HOT_ROWS = 100_000


def hot_keys(left: DataFrame, key: str | list[str], scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys of more than ``hot_rows`` rows, counted with partial sums; None if there are none."""
    if left.count() <= hot_rows:  # from the footers alone where the left side is a kept table
        return None
    keys = [key] if isinstance(key, str) else key
    hot = left.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(*keys)
    hot = scratch.keep(hot, "hot-keys")
    return None if hot.isEmpty() else hot


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], scratch: Scratch, hot_rows: int = HOT_ROWS, hot: DataFrame | str | None = "unknown") -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row a value.

    The right rows of hot keys, at most left rows / ``hot_rows`` of them, go to the tasks of the
    left side; the rest is an ordinary join.  ``hot`` gives known hot keys.  A null key meets
    nothing; empty sides give an empty result.
    """
    if isinstance(hot, str):
        hot = hot_keys(left, key, scratch, hot_rows)
    if hot is None:
        return left.join(right, key)
    known = F.broadcast(hot)
    loud = left.join(F.broadcast(right.join(known, key)), key)
    return loud.unionByName(left.join(known, key, "left_anti").join(right, key).select(*loud.columns))
