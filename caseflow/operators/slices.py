"""Ordered work per key, in slices of the key's time line.

A window partitioned by account alone puts all rows of an account into one task, and one
account may own a third of the data. Here the account's time line is cut into slices of
fixed width, the window is partitioned by (key, slice), and what a slice needs to know of
the others is carried in: one small row per (key, slice), reduced on the map side. The
full rows are shuffled once, by (key, slice). The carry table has at most one row per
slice of the calendar and key, and never more rows than the data.

A slice in which rows lie dense is cut further, at quantiles of its own rows (``dense.py``).

Frames always run from the first row to the current one. Spark keeps a running state for
those; a frame that ends at the last row is evaluated anew for every row, so a look ahead
is written as a look back over the descending order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.times import HOUR

SLICE = "_slice"
NO_TIME = -(1 << 62)


def slice_of(position: Column, width: int = HOUR) -> Column:
    """Start of the slice that holds a long position; rows without one share a first slice."""
    return F.coalesce(position - F.pmod(position, F.lit(width)), F.lit(NO_TIME))


def before(keys: Sequence[str]):
    """All earlier slices of a key."""
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def after(keys: Sequence[str]):
    """All later slices of a key, nearest last."""
    return (
        Window.partitionBy(*keys)
        .orderBy(F.col(SLICE).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a null key meets a null key; the right keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    position: Column,
    order: Sequence[Column],
    weights: dict[str, Column],
    width: int = HOUR,
) -> DataFrame:
    """Adds, per row, the sum of each weight over the rows of its key that come before it.

    ``order`` must begin with ``position`` (nulls first) and should be total.
    """
    keys, names = list(keys), list(weights)
    sliced = (
        rows.withColumn(SLICE, slice_of(position, width))
        .withColumns({f"_w_{n}": w.cast("long") for n, w in weights.items()})
        .repartition(*keys, SLICE)
    )
    # The counts are not used. They make this branch ask for the same columns as the one below, so
    # that both read one shuffle, and the rows are neither computed nor sent twice.
    same = [F.count(c).alias(f"_c_{i}") for i, c in enumerate(c for c in rows.columns if c not in keys)]
    per_slice = sliced.groupBy(*keys, SLICE).agg(
        *[F.sum(f"_w_{n}").alias(f"_w_{n}") for n in names], *same
    )
    # what lies before a slice enters it as one row that sorts first
    used = F.greatest(F.lit(0), *[F.col(f"_c_{i}") for i in range(len(same))]) >= 0
    opening = (
        per_slice.filter(used)
        .select(
            *keys, SLICE, *[F.sum(f"_w_{n}").over(before(keys)).alias(f"_w_{n}") for n in names]
        )
        .withColumn("_real", F.lit(0))
        .repartition(*keys, SLICE)
    )
    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy("_real", *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = (
        sliced.withColumn("_real", F.lit(1))
        .unionByName(opening, allowMissingColumns=True)
        .withColumns({f"_b_{n}": F.sum(f"_w_{n}").over(inside) for n in names})
        .filter("_real = 1")
    )
    return summed.select(
        *rows.columns, *[F.coalesce(F.col(f"_b_{n}"), F.lit(0)).alias(n) for n in names]
    )


def ordinal(
    rows: DataFrame,
    keys: Sequence[str],
    position: Column,
    order: Sequence[Column],
    name: str = "ordinal",
    width: int = HOUR,
) -> DataFrame:
    """Zero-based place of each row within its key."""
    return running_totals(rows, keys, position, order, {name: F.lit(1)}, width)
