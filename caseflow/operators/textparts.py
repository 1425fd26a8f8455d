"""Ordered text of a key, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.times import HOUR
from caseflow.operators.slices import running_totals, same_key
from caseflow.sources.sinks import staged

PART_CHARS = 4_000_000
# Keys are looked at in this many groups, by their hash, to find whether one has a long text.
KEY_GROUPS = 1 << 16


def text_parts(
    rows: DataFrame,
    keys: Sequence[str],
    text: Column,
    sep: str,
    position: Column,
    tie: Sequence[Column] = (),
    part_chars: int = PART_CHARS,
    width: int = HOUR,
    collect: dict[str, Column] | None = None,
    few_rows: bool = False,
) -> DataFrame:
    """Joins the texts of each key in order of ``position`` and ``tie``.

    Gives ``(keys, part_no, n_rows, text)``. A key whose text stays under ``part_chars`` has the
    single part 0, which is the whole text. A longer one continues in further parts, whose texts
    joined by ``sep`` are the whole text; no task ever holds more than one part of it, and a value
    never nears the size limit of a Spark string. Null texts are left out. ``collect`` names more
    expressions to gather, in the same order, as arrays.

    The rows are staged, and the length of each key's text is counted first. Keys of a single part are
    gathered in one shuffle; only rows of longer ones are placed by slices of ``width``. With ``few_rows``
    the rows of a key are as few as ``top_per`` leaves, and are placed in the window that ranked them.
    """
    keys, extra = list(keys), collect or {}
    shaped = rows.select(
        *keys,
        position.alias("_pos"),
        *[t.alias(f"_tie_{i}") for i, t in enumerate(tie)],
        text.alias("_text"),
        *[c.alias(f"_x_{name}") for name, c in extra.items()],
    )
    order = ["_pos", *[f"_tie_{i}" for i in range(len(tie))]]
    # a null text takes no place, so a first part holds the first text
    weight = F.coalesce(F.length("_text") + len(sep), F.lit(0))
    if few_rows:
        earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        placed = shaped.withColumn("_before", F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
    else:
        placed = _placed(staged(shaped), keys, order, weight, part_chars, width)
    part = F.floor(F.col("_before") / part_chars).cast("int")
    gathered = F.array_sort(
        F.collect_list(F.struct(*order, "_text", *[f"_x_{name}" for name in extra]))
    )
    parts = placed.groupBy(*keys, part.alias("part_no")).agg(
        F.count("_text").alias("n_rows"), gathered.alias("_all")
    )
    return parts.select(
        *keys,
        "part_no",
        "n_rows",
        F.concat_ws(sep, F.col("_all._text")).alias("text"),
        *[F.col(f"_all._x_{name}").alias(name) for name in extra],
    )


def long_keys(rows: DataFrame, keys: Sequence[str], weight: Column, most: int) -> DataFrame | None:
    """The keys whose weights sum to ``most`` or more, or None if there are none.

    Sums of groups of keys are looked at first, as they fall together in the tasks that read the rows; keys
    are summed one by one only in groups that reach ``most``.
    """
    keys = list(keys)
    grouped = rows.select(
        *keys, weight.cast("long").alias("_w"), F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).alias("_group")
    )
    heavy = grouped.groupBy("_group").agg(F.sum("_w").alias("_sum")).filter(F.col("_sum") >= most).select("_group")
    if heavy.isEmpty():
        return None
    sums = grouped.join(staged(heavy), "_group", "left_semi").groupBy(*keys).agg(F.sum("_w").alias("_sum"))
    long = staged(sums.filter(F.col("_sum") >= most).select(*keys))
    return None if long.isEmpty() else long


def _placed(
    shaped: DataFrame, keys: list[str], order: Sequence[str], weight: Column, part_chars: int, width: int
) -> DataFrame:
    """Adds ``_before``, the length of the key's text before the row; 0 where the whole text is one part."""
    nothing = F.lit(0).cast("long")
    long = long_keys(shaped, keys, weight, part_chars)
    if long is None:
        # rows go to their keys before they are gathered, so that lists are made of all rows and not merged
        return shaped.repartition(*keys).withColumn("_before", nothing)
    cut = running_totals(
        same_key(shaped, long, keys, "left_semi"),
        keys,
        F.col("_pos"),
        [F.col(o) for o in order],
        {"_before": weight},
        width,
    )
    return same_key(shaped, long, keys, "left_anti").withColumn("_before", nothing).unionByName(cut)


def by_part(rows: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Left joins of tables to ``rows``, one row per key and part.

    A table with a ``part_no`` has its texts on the rows of their parts; the values of one without stand
    on every row of the key. A key has as many rows as the table with most parts, at least part 0.
    """
    parts = [t for t in (rows, *tables) if "part_no" in t.columns]
    numbers = rows.select(key, F.lit(0).alias("part_no"))
    for table in parts:
        numbers = numbers.unionByName(table.select(key, F.col("part_no").cast("int").alias("part_no")))
    joined = numbers.distinct().join(rows.select(key).distinct(), key, "left_semi")
    for table in (rows, *tables):
        joined = joined.join(table, [key, "part_no"] if "part_no" in table.columns else [key], "left")
    return joined


def json_parts(
    rows: DataFrame,
    keys: Sequence[str],
    record: Column,
    position: Column,
    tie: Sequence[Column] = (),
    **options,
) -> DataFrame:
    """The records of each key as a JSON array; each part of a long one is an array by itself."""
    parts = text_parts(rows, keys, F.to_json(record), ",", position, tie, **options)
    return parts.withColumn("text", F.concat(F.lit("["), "text", F.lit("]"))).withColumnRenamed(
        "text", "records"
    )
