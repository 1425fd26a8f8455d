"""Duplicates, latest rows and top rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_exact(rows: DataFrame, keys: Sequence[str], keep_max: Sequence[str]) -> DataFrame:
    """One row per key with the maximum of the other columns.

    An aggregate and not ``row_number``: copies fall together before the shuffle, so a row that
    makes up a third of the table costs one row per task.
    """
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in keep_max])


def top_per(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each key. Spark cuts each task to ``n`` per key before the shuffle
    (WindowGroupLimit), so the window sees at most ``n`` rows per key and task."""
    name = rank or "_rank"
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    top = ranked.filter(F.col(name) <= n)
    return top if rank else top.drop(name)


def latest_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per(rows, keys, order, 1)
