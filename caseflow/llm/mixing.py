"""Mixing sources to target weights by capped water-filling, and seeded repetitions.

Each source gets a share of the whole by its weight, at most ``max_epochs`` times its own size.
What a cap cuts off goes to the others by weight, until no share is above its cap: the level of
the water is found in closed form over the sources in the order in which their caps are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import text_of, word_count

# Hex digits of the order hash that name a bucket: 4,096 buckets of a source.
BUCKET_DIGITS = 3


def targets(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size, weight).

    Sources are few (names, not documents), so one window over them is small.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size, weight = F.col("source_size"), F.col("weight")
    cap = size * F.lit(max_epochs)
    # The level if exactly the sources before this one are at their caps.
    level = (
        F.sum("source_size").over(everything) * F.lit(share)
        - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(max_epochs)
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = sources.withColumn("__level", level)
    first = F.when(F.col("__level") * weight <= cap, F.col("__level"))
    # the first source in the order whose cap is not reached sets the level for all that follow
    leveled = leveled.withColumn("__water", F.first(first, ignorenulls=True).over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return leveled.withColumn(
        "target", F.when(F.col("__water").isNull(), cap).otherwise(F.least(cap, F.col("__water") * weight))
    ).drop("__level", "__water")


def rank_weights(source: Column, weights: tuple[int, ...]) -> Column:
    """Weights dealt to sources in the order of their names' code points, nulls last."""
    rank = F.row_number().over(Window.orderBy(source.asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(rank, F.lit(len(weights))) + 1)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """Per document: doc_id, source, text_hash, size, source_size, target, whole, copies, taken.

    A source whose target is r times its size gives every document floor(r) times, and once more
    documents in the order of a seeded hash, until the rest of the target is met; the last of them
    is taken if half of it fits. So the words taken from a source miss its target by at most half
    a document, and a document is never taken more than ceil(max_epochs) times.

    The seeded order is cut into buckets by the hash. Sums of buckets say where a bucket begins, so
    running sums are made within buckets and no source is ordered in one task. Rows without an id are
    ordered by a hash of their text. ``whole`` is floor(r), ``copies`` that or one more.

    Null text has size 0, a null source is a source of its own, the last in order. Repeated rows are
    documents of their own. Words are counted over whole texts. Empty table: no rows. If all sizes
    are 0, targets are 0.
    """
    unnamed = F.concat(F.lit("no id "), F.xxhash64(text_of(text_col)).cast("string"))
    name = F.coalesce(docs[id_col].cast("string"), unnamed)
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
        word_count(text_of(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")).alias("order"),
    ).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    sources = targets(sources.withColumn("weight", rank_weights(F.col("source"), weights)), share, max_epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    starts = (
        starts.alias("a")
        .join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .select("a.source", "a.bucket", "bucket_start", "source_size", "target")
    )
    within = (
        Window.partitionBy("a.source", "a.bucket")
        .orderBy("order", "doc_id", "text_hash", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))
    joined = rows.alias("a").join(starts.alias("b"), same)
    placed = joined.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("bucket_start"))
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.try_divide("target", "source_size")))
    rest = F.col("target") - F.col("__whole") * F.col("source_size")
    once_more = (2 * F.col("__before") + F.col("size")) <= 2 * rest
    return (
        placed.withColumn("__whole", whole.cast("long"))
        .withColumn("copies", F.col("__whole") + F.when(once_more & (rest > 0), 1).otherwise(0))
        .select(
            "doc_id",
            "a.source",
            "text_hash",
            "size",
            "source_size",
            "target",
            F.col("__whole").alias("whole"),
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it.

    Rows of one id, source and text are told apart only where ``mix`` takes some of them once more and others
    not. They follow each other in its order, so that is one such group of a source at most; its rows are
    numbered, in any order, and the first ones are taken once more.
    """
    counts = mix(docs, id_col, text_col, source_col, **how).groupBy("doc_id", "source", "text_hash")
    more = F.sum(F.col("copies") - F.col("whole"))
    counts = counts.agg(F.max("whole").alias("__whole"), more.alias("__more"), F.count(F.lit(1)).alias("__rows"))
    counts = counts.filter("__whole > 0 or __more > 0")
    marked = docs.withColumn("__hash", F.xxhash64(text_of(text_col)))
    same = (
        marked[id_col].eqNullSafe(counts["doc_id"])
        & marked[source_col].cast("string").eqNullSafe(counts["source"])
        & (marked["__hash"] == counts["text_hash"])
    )
    own = [marked[c] for c in docs.columns]
    found = marked.join(counts, same).select(*own, "__hash", "__whole", "__more", "__rows")
    split = (F.col("__more") > 0) & (F.col("__more") < F.col("__rows"))
    alike = found.filter(~split).withColumn("__times", F.col("__whole") + F.when(F.col("__more") > 0, 1).otherwise(0))
    order = Window.partitionBy(id_col, source_col, "__hash").orderBy("__hash")
    nth = F.row_number().over(order)
    apart = found.filter(split).withColumn("__times", F.col("__whole") + F.when(nth <= F.col("__more"), 1).otherwise(0))
    every = alike.unionByName(apart).filter("__times > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))
    return every.select(*docs.columns, times.alias("__n")).drop("__n")
