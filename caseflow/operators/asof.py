"""Nearest-in-time join: each left row meets the closest right row of its key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.times import MONTH, micros
from caseflow.operators.dense import DENSE_ROWS, dense_cuts, with_slice
from caseflow.operators.slices import SLICE, after, before


@dataclass(frozen=True)
class Series:
    """One right side. ``tie`` lists numeric columns: among rows of one instant the smallest wins."""

    rows: DataFrame
    ts: str
    values: Sequence[str]
    tie: Sequence[str] = ()
    tolerance_us: int | None = None


def reading(us: Column, values: Sequence[str], tie: Sequence[str] = ()) -> Column:
    """A right row as a struct; its tie break is part of it, so it sorts alike wherever it is."""
    return F.struct(
        us.alias("us"),
        F.array(*[-F.col(t).cast("double") for t in tie]).cast("array<double>").alias("tie"),
        F.struct(*values).alias("values"),
    )


def nearest(
    left: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    series: dict[str, Series],
    width_us: int = MONTH,
    dense_rows: int = DENSE_ROWS,
) -> DataFrame:
    """Adds to each left row a struct per series: its nearest row's values, ``us`` and ``gap_us``.

    Equal distance goes to the earlier right row, the tolerance is inclusive, and the struct is
    null where nothing is in reach or the left row has no time or no key.
    """
    keys = list(keys)
    kept = [c for c in left.columns if c not in keys]
    whole = F.col(left_ts).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    tagged = [
        left.filter(whole).select(
            *keys, F.struct(micros(F.col(left_ts)).alias("us"), F.struct(*kept).alias("row"))
            .alias("_left"),
        )
    ]
    for name, s in series.items():
        present = F.col(s.ts).isNotNull()
        for k in keys:
            present = present & F.col(k).isNotNull()
        tagged.append(
            s.rows.filter(present).select(
                *keys, reading(micros(F.col(s.ts)), s.values, s.tie).alias(f"_r_{name}")
            )
        )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    limits = {name: s.tolerance_us for name, s in series.items()}
    found = nearest_tagged(rows, keys, limits, width_us, dense_rows).select(*keys, "row.*", *series)
    apart = left.filter(~whole).select(
        *keys, *kept, *[F.lit(None).cast(found.schema[n].dataType).alias(n) for n in series]
    )
    return found.unionByName(apart)


def nearest_tagged(
    rows: DataFrame,
    keys: Sequence[str],
    limits: dict[str, int | None],
    width_us: int = MONTH,
    dense_rows: int = DENSE_ROWS,
) -> DataFrame:
    """The same over one table in which left rows and readings are marked.

    ``_left`` holds a struct ``(us, row)`` on left rows, ``_r_<name>`` a ``reading`` on right rows of
    a series, null elsewhere. Gives ``(keys, us, row, <name>…)`` per left row.

    The rows are shuffled once, by key and slice. From that one shuffle Spark reads twice: to tell
    each slice that has left rows the last reading before it and the first after it, one small row
    per slice; and to sort rows and told readings together. Each left row then looks back over the
    ascending and over the descending order. The width of a slice never changes the result; slices of
    more than ``dense_rows`` rows are cut where their rows lie.
    """
    keys, names = list(keys), list(limits)
    rights = [F.col(f"_r_{n}") for n in names]
    us = F.coalesce(F.col("_left.us"), *[r["us"] for r in rights])
    cuts = dense_cuts(rows, keys, us, width_us, dense_rows)
    placed = with_slice(rows, keys, us, width_us, cuts).repartition(*keys, SLICE)

    def extreme(n: str, sign: int, alias: str) -> Column:
        r = F.col(f"_r_{n}")
        order = F.struct(sign * r["us"], r["tie"])
        return F.max_by(r, F.when(r.isNotNull(), order)).alias(alias)

    told = (
        placed.groupBy(*keys, SLICE)
        .agg(
            F.count("_left").alias("_asked"),
            *[extreme(n, 1, f"_last_{n}") for n in names],
            *[extreme(n, -1, f"_first_{n}") for n in names],
        )
        .select(
            *keys,
            SLICE,
            "_asked",
            *[F.last(f"_last_{n}", True).over(before(keys)).alias(f"_prev_{n}") for n in names],
            *[F.last(f"_first_{n}", True).over(after(keys)).alias(f"_next_{n}") for n in names],
        )
        .filter("_asked > 0")
    )
    neighbours = F.array(
        *[
            F.struct(
                *[
                    (F.col(f"_{side}_{n}") if m == n else F.lit(None).cast(rows.schema[f"_r_{m}"].dataType))
                    .alias(f"_r_{m}")
                    for m in names
                ]
            )
            for n in names
            for side in ("prev", "next")
        ]
    )
    carried = (
        told.select(*keys, SLICE, F.explode(neighbours).alias("_c"))
        .select(
            *keys,
            F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"),
            *[F.col(f"_c._r_{n}") for n in names],
            SLICE,
        )
        .filter(F.coalesce(*[r["us"] for r in rights]).isNotNull())
        .repartition(*keys, SLICE)
    )
    all_rows = placed.unionByName(carried).select(
        *keys,
        SLICE,
        "_left",
        *rights,
        us.alias("_us"),
        F.col("_left").isNotNull().cast("int").alias("_side"),
        F.coalesce(*[r["tie"] for r in rights]).alias("_tie"),
    )

    def looking(first: Column):
        return (
            Window.partitionBy(*keys, SLICE)
            .orderBy(first, "_side", "_tie")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

    back, ahead = looking(F.col("_us")), looking(F.col("_us").desc())
    seen = all_rows.select(
        *keys,
        "_us",
        "_left",
        *[F.last(f"_r_{n}", True).over(back).alias(f"_b_{n}") for n in names],
        *[F.last(f"_r_{n}", True).over(ahead).alias(f"_f_{n}") for n in names],
    ).filter("_left is not null")

    def chosen(n: str) -> Column:
        b, f = F.col(f"_b_{n}"), F.col(f"_f_{n}")
        b_gap, f_gap = F.col("_us") - b["us"], f["us"] - F.col("_us")
        pick = F.when(f.isNull() | (b.isNotNull() & (b_gap <= f_gap)), b).otherwise(f)
        gap = F.abs(F.col("_us") - pick["us"])
        values = rows.schema[f"_r_{n}"].dataType["values"].dataType.names
        found = F.struct(
            *[pick["values"][v].alias(v) for v in values],
            pick["us"].alias("us"),
            gap.alias("gap_us"),
        )
        reached = pick.isNotNull()
        if limits[n] is not None:
            reached = reached & (gap <= limits[n])
        return F.when(reached, found).alias(n)

    return seen.select(
        *keys, F.col("_us").alias("us"), F.col("_left.row").alias("row"), *[chosen(n) for n in names]
    )
