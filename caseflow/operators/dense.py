"""Slices in which rows lie dense, cut where their rows are.

A slice of fixed width may hold most rows of a key: a burst of readings within an hour. Its pieces are
slices like others, named by where they start, so nothing that works on slices need know of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.times import HOUR
from caseflow.operators.slices import SLICE, same_key, slice_of
from caseflow.sources.sinks import staged

# Rows of a key and slice above which the slice is cut where its rows lie dense, and into how many.
DENSE_ROWS = 200_000
PIECES = 64
# Slices that are cut are told to every task if they are no more than this, else they are joined.
FEW_CUTS = 10_000


def dense_cuts(
    rows: DataFrame,
    keys: Sequence[str],
    position: Column,
    width: int = HOUR,
    most: int = DENSE_ROWS,
    pieces: int = PIECES,
) -> DataFrame | None:
    """Where to cut the slices of more than ``most`` rows so that their pieces hold about as many each.

    Gives ``(keys, SLICE, _cuts)``, or None if no slice is that dense. Counts and quantile sketches fall
    together in the tasks that read the rows; of ``rows`` only the keys and the position are read. Rows of
    one position are never parted.
    """
    keys = list(keys)
    placed = rows.select(*keys, slice_of(position, width).alias(SLICE), position.alias("_at")).filter("_at is not null")
    dense = placed.groupBy(*keys, SLICE).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).drop("_n")
    if dense.isEmpty():
        return None
    dense = staged(dense)
    shares = [i / pieces for i in range(1, pieces)]
    inside = same_key(placed, dense, [*keys, SLICE], "left_semi")
    return staged(inside.groupBy(*keys, SLICE).agg(F.percentile_approx("_at", shares, 1000).alias("_cuts")))


def with_slice(
    rows: DataFrame, keys: Sequence[str], position: Column, width: int = HOUR, cuts: DataFrame | None = None
) -> DataFrame:
    """Adds the slice of each row: that of its calendar, or the piece of it that ``dense_cuts`` made."""
    placed = rows.withColumn(SLICE, slice_of(position, width))
    if cuts is None:
        return placed
    told = F.broadcast(cuts) if cuts.count() <= FEW_CUTS else cuts
    joined = same_key(placed.withColumn("_at", position), told, [*keys, SLICE], "left")
    piece = F.array_max(F.filter("_cuts", lambda c: c <= F.col("_at")))
    return joined.withColumn(SLICE, F.coalesce(piece, F.col(SLICE))).drop("_at", "_cuts")
