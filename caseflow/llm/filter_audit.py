"""How filters act on each other: for every order of the filters, what each step keeps, removes and loses.

The duplicate filter needs the whole table. A counting Bloom sketch runs first: tasks count where the
hashes of their texts fall, the counts are merged segment by segment, and a text one of whose counters
stands at one is unique for certain. Only the others, the possible repeats, send their texts, which are
compared in full for the smallest id of each. The flags of a document are one mask; masks are counted
per part, and every figure of every order is a sum of those counts.
"""

from __future__ import annotations

import importlib
import itertools
import os
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import SPACE_RUN, in_tasks, text_of
from caseflow.llm.hashing import mix
from caseflow.sources.sinks import staged

FILTERS = "ABCDE"
# Counters a text falls on, counters held for each document, and bounds of the whole sketch.
HASHES = 3
COUNTERS_PER_ROW = 16
LEAST_COUNTERS = 1 << 16
MOST_COUNTERS = 1 << 28
SEGMENT_BITS = 20
_AT_ONCE = 1 << 18


def flags(text: Column) -> Column:
    """A mask of the filters that a text fails on its own: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    few = F.size(words) < 100
    alike = 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    loud = 100 * capitals.cast("long") > 10 * F.length(text).cast("long")
    signs = text.rlike("[#$%&*|]")
    failed = [few, alike, loud, signs]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)), F.lit(0)).cast("int")


def sketch_size(rows: int, per_row: int = COUNTERS_PER_ROW, most: int = MOST_COUNTERS) -> int:
    """Counters for so many rows: a power of two, ``most`` at most (a bit each where the sketch is read)."""
    return min(most, max(LEAST_COUNTERS, 1 << max(0, per_row * rows - 1).bit_length()))


def _places(hashes: np.ndarray, counters: int) -> np.ndarray:
    keys = hashes.view(np.uint64)
    steps = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return mix(keys[:, None] ^ steps[None, :]) & np.uint64(counters - 1)


def _counted(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Per run of rows and segment: the counters that were met once, and more than once."""
    for batch in batches:
        hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(hashes), _AT_ONCE):
            place, times = np.unique(_places(hashes[at : at + _AT_ONCE], counters), return_counts=True)
            segment = (place >> np.uint64(SEGMENT_BITS)).astype(np.int32)
            within = (place & np.uint64((1 << SEGMENT_BITS) - 1)).astype("<u4")
            names, starts = np.unique(segment, return_index=True)
            ends = [*starts[1:], len(segment)]
            rows = []
            for start, end in zip(starts, ends, strict=True):
                part, single = within[start:end], times[start:end] == 1
                rows.append((part[single].tobytes(), part[~single].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])],
                names=["segment", "once", "more"],
            )


def _merged(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Per segment, whose rows follow each other: a bit for each counter that stands above one."""
    size = min(counters, 1 << SEGMENT_BITS)
    held, count = None, np.zeros(size, np.uint8)

    def done():
        bits = np.packbits(count > 1, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([bits])], names=["segment", "bits"])

    for batch in batches:
        for segment, once, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if segment != held:
                if held is not None:
                    yield done()
                held, count = segment, np.zeros(size, np.uint8)
            at = np.frombuffer(once, "<u4")
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more, "<u4")] = 2
    if held is not None:
        yield done()


def sketch(hashes: DataFrame, counters: int) -> np.ndarray:
    """The merged sketch of a column of hashes: a bit for each counter that more than one row met.

    Tasks count runs of rows; segments are merged as streams of rows, a segment in memory at a time.
    What comes to the driver is ``counters`` bits, 32 MB at most.
    """
    partial = hashes.mapInArrow(in_tasks(_counted, counters), "segment int, once binary, more binary")
    dealt = partial.repartition("segment").sortWithinPartitions("segment")
    whole = np.zeros(max(1, counters >> 3), np.uint8)
    size = min(counters, 1 << SEGMENT_BITS) >> 3
    for segment, bits in dealt.mapInArrow(in_tasks(_merged, counters), "segment int, bits binary").collect():
        whole[segment * size : (segment + 1) * size] = np.frombuffer(bits, np.uint8)
    return whole


def met_again(hashes: pa.Array, bits: np.ndarray) -> pa.Array:
    """Whether each hash may have come more than once; false is certain."""
    place = _places(hashes.to_numpy(zero_copy_only=False).astype(np.int64), len(bits) << 3)
    set_ = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
    return pa.array(set_.all(axis=1))


def possible_repeat(column: str, bits) -> Column:
    """``met_again`` as a column over a broadcast sketch; only the hash goes to Python."""
    module = met_again.__module__
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    def run(hashes: pa.Array) -> pa.Array:
        if root not in sys.path:
            sys.path.append(root)
        return importlib.import_module(module).met_again(hashes, bits.value)

    return F.arrow_udf(run, "boolean")(F.col(column))


def failures(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    salts: int = 16,
    digest: Callable[[Column], Column] = F.xxhash64,
    most: int = MOST_COUNTERS,
) -> DataFrame:
    """One row per document: doc_id, part, mask (A 1, B 2, C 4, D 8, E 16).

    E marks a text that some smaller id has too. Rows without an id come after all others, so they fail
    E if a row with an id has their text, and repeated rows of one id do not fail by each other. Null
    text counts as empty, a null part as the empty string. Empty table: no rows.

    The sketch has ``COUNTERS_PER_ROW`` counters a row (one unique text in 200 is then not cleared), ``most``
    at most: beyond that clearing gets weaker, more texts are sent and compared, and results stay the same.
    """
    text = text_of(text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    marked = staged(rows.select("doc_id", "part", flags(F.col("text")).alias("mask"), digest(F.col("text")).alias("h")))
    bits = docs.sparkSession.sparkContext.broadcast(
        sketch(marked.select("h"), sketch_size(marked.count(), most=most))
    )
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")

    suspects = rows.select("doc_id", "text", digest(F.col("text")).alias("h")).filter(possible_repeat("h", bits))
    groups = (
        suspects.groupBy("h", salt, "text")
        .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .groupBy("h", "text")
        .agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    )
    found = staged(
        groups.groupBy("h")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.max("n").alias("n"))
        .filter("n > 1")
    )
    single = found.filter("texts = 1").select("h", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    looked = marked.withColumn("again", possible_repeat("h", bits))
    clear = looked.filter("not again").select("doc_id", "part", "mask")
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    mask = (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask")
    open_rows = looked.filter("again").withColumn("salt", salt)
    several = found.filter("texts > 1").select("h")
    apart = None
    if not several.isEmpty():  # different texts of one hash: told apart by the text itself
        open_rows = open_rows.join(several, "h", "left_anti")
        own = rows.withColumn("h", digest(F.col("text"))).join(several, "h", "left_semi")
        apart = own.join(groups.join(several, "h", "left_semi").select("h", "text", "first"), ["h", "text"])
        apart = apart.withColumn("mask", flags(F.col("text"))).select("doc_id", "part", mask)
    joined = open_rows.join(single, ["h", "salt"], "left").select("doc_id", "part", mask)
    every = clear.unionByName(joined)
    return every if apart is None else every.unionByName(apart)


def mask_counts(failed: DataFrame, labels: DataFrame, good: Column, toxic: Column) -> DataFrame:
    """Per part and mask: n, good, toxic (documents that carry such a label).

    ``good`` and ``toxic`` are conditions on ``labels`` (doc_id and more); of several labels of a document
    one is enough. Rows of one id fall together before they are sent.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("good"), F.coalesce(F.bool_or(toxic), F.lit(False)).alias("toxic"))
    )
    rows = failed.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(known, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every step of every order of the filters, per part, out of mask counts (bit i: the i-th filter failed).

    Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. A
    document that fails k filters is removed by each in a k-th of the orders: that is ``shapley``.
    """
    every = ["".join(p) for p in itertools.permutations(filters)]
    steps = (
        counts.withColumn("filter_order", F.explode(F.array(*[F.lit(x) for x in every])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
        .withColumn("own", F.expr(f"shiftleft(1, instr('{filters}', substring(filter_order, step, 1)) - 1)"))
        .withColumn(
            "before",
            F.expr(
                "aggregate(slice(split(filter_order, ''), 1, step - 1), 0,"
                f" (a, x) -> a + shiftleft(1, instr('{filters}', x) - 1))"
            ),
        )
    )
    mask, n = F.col("mask"), F.col("n")
    fails = mask.bitwiseAND(F.col("own")) != 0
    gone = mask.bitwiseAND(F.col("before")) != 0
    total = lambda when, what=n: F.sum(F.when(when, what).otherwise(0)).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, F.col("good")).alias("good_lost"),
        total(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
        total(fails, F.expr(f"n * {len(every)} div bit_count(mask)")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``orders`` of the five filters over ``docs``; ``labels`` has doc_id, quality and toxic."""
    counts = mask_counts(failures(docs, **how), labels, F.col("quality") == 1, F.col("toxic") == 1)
    return orders(staged(counts))
