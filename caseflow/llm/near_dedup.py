"""Near copies by ProbMinHash: signatures of weighted shingles, bands, exact verification, classes.

Two texts are linked if the probability Jaccard similarity of their shingles, weighted by how often
they occur, reaches the threshold; without repeated shingles that is the Jaccard similarity. Classes
are the connected components of the links.

A signature has ``bands * rows`` components. Every shingle is a Poisson process whose rate is its
weight and whose arrivals each fall on a random component; a component keeps the shingle of its
earliest arrival. Arrivals are made up to a horizon, and once every component is taken before it, no
later arrival can change the signature.

Texts that share a band meet in its bucket. Not all pairs of a bucket are compared. In two rounds all
members of a bucket are compared with one of them, the pivot: the first, then the one with the most
links; members of one class need not meet. What is left are texts whose buckets still hold several
classes. Their shingles are put in one order, rare ones first, and each text shows the first of them,
those before which at most a fifth of its weight stands (``1 - threshold``). Two texts that are alike
share one of these, and where the first shared one stands in both bounds their similarity from above;
pairs that cannot reach the threshold do not meet, nor do two texts of the largest class that shows
a shingle. So a bucket of near copies costs a few comparisons each, and yet every pair of a bucket is
compared, or in one class, or proven apart: no cap, and no link lost. The order only needs to be one
and the same, so counts that meet in a bounded table of counters are good enough for it. A pair at 0.8
misses all 30 bands of 5 rows once in 150,000.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import id_field, in_tasks, slices, text_of
from caseflow.llm.hashing import mix, windows
from caseflow.sources.sinks import staged

# A pivot's comparisons are dealt over so many groups at most.
SALTS = 1024
# Bytes of the table that tells common shingles from rare ones, at most; it is cut into segments.
MOST_COUNTERS = 1 << 26
SEGMENT_BITS = 20


def weighted(text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(windows(text, width), return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signature(shingles: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The shingle each component keeps."""
    if len(shingles) == 1:
        return np.full(size, shingles[0])
    horizon = size * (np.log(size) + 4) / weights.sum()
    while True:
        first, kept = np.full(size, np.inf), np.zeros(size, np.uint64)
        on, rate, x, step = shingles, weights.astype(np.float64), np.zeros(len(shingles)), 0
        while len(on):
            # so many arrivals of each shingle at a time that few shingles need few rounds
            block = int(min(4096, max(1, 2 * size * np.log(size) // len(on))))
            seeds = mix(on[:, None] + np.arange(step, step + block, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95))
            times = x[:, None] - np.cumsum(np.log(_uniform(seeds)), axis=1) / rate[:, None]
            near = times <= min(horizon, first.max())
            at = times[near]
            place = (mix(seeds[near]) % np.uint64(size)).astype(np.int64)
            owner = np.broadcast_to(on[:, None], near.shape)[near]
            order = np.argsort(-at, kind="stable")  # the earliest is written last and stays
            order = order[at[order] < first[place[order]]]
            first[place[order]], kept[place[order]] = at[order], owner[order]
            x, step = times[:, -1], step + block
            going = x <= min(horizon, first.max())
            on, rate, x = on[going], rate[going], x[going]
        if first.max() <= horizon:
            return kept
        horizon *= 2


def band_keys(kept: np.ndarray, bands: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in kept.reshape(bands, -1).T:
        key = mix(key ^ column)
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: the sum over shared i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio)
    below = np.concatenate(([0.0], np.cumsum(y[order])))
    above = x.sum() - np.concatenate(([0.0], np.cumsum(x[order])))
    shared = (x > 0) & (y > 0)
    at = np.searchsorted(ratio[order], ratio[shared])
    return float((x[shared] / (above[at] + ratio[shared] * below[at])).sum())


def _marked(
    batches: Iterator[pa.RecordBatch], names: list[str], width: int, bands: int, rows: int
) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        nodes, keys = [], []
        for text in texts:
            shingles, weights = weighted(text, width)
            held = shingles.tobytes() + weights.astype("<i8").tobytes()
            nodes.append(int.from_bytes(hashlib.blake2b(held, digest_size=8).digest(), "little", signed=True))
            keys.append(band_keys(signature(shingles, weights, bands * rows), bands) if len(shingles) else [])
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(nodes, pa.int64()), part.column(2), pa.array(keys, pa.list_(pa.int64()))],
            names=names,
        )


def marks(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, node (a hash of its weighted shingles), x (a hash of its text), bands."""

    schema = T.StructType(
        [
            id_field(docs, id_col),
            T.StructField("node", T.LongType()),
            T.StructField("x", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    text = text_of(text_col)
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("x")).mapInArrow(
        in_tasks(_marked, schema.names, width, bands, rows), schema
    )


def _compared(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    pivot, held = None, None
    for part, rows in slices(batches, 3):
        out: list[tuple[int, int, bool]] = []
        for at, salt, node, text in zip(*(part.column(i).to_pylist() for i in range(3)), rows, strict=True):
            if node is None:
                pivot, held = (at, salt), weighted(text, width)
            elif pivot == (at, salt):
                out.append((at, node, similarity(held, weighted(text, width)) >= threshold - 1e-12))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_())],
            names=["pivot", "node", "linked"],
        )


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (pivot, node) with ``linked``. A group holds its pivot's shingles and one text at a time."""

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node", "pivot"), F.lit(SALTS)).cast("int"))
    members = salted.join(texts, "node").select("pivot", "salt", "node", "text")
    own = salted.select("pivot", "salt").distinct().join(texts.withColumnRenamed("node", "pivot"), "pivot")
    both = members.unionByName(own.withColumn("node", F.lit(None).cast("long")).select("pivot", "salt", "node", "text"))
    dealt = both.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("node").asc_nulls_first())
    return dealt.mapInArrow(in_tasks(_compared, width, threshold), "pivot long, node long, linked boolean")


def _counted(batches: Iterator[pa.RecordBatch], width: int, counters: int) -> Iterator[pa.RecordBatch]:
    """How often the shingles of a run of texts fall on each counter, per segment of counters."""
    for _, texts in slices(batches):
        own = [weighted(t, width)[0] for t in texts]
        places, times = np.unique(np.concatenate(own) & np.uint64(counters - 1), return_counts=True)
        segments, starts = np.unique(places >> np.uint64(SEGMENT_BITS), return_index=True)
        within = (places & np.uint64((1 << SEGMENT_BITS) - 1)).astype("<u4")
        cuts = [slice(i, j) for i, j in zip(starts, [*starts[1:], len(places)], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(segments.astype(np.int32)),
                pa.array([within[c].tobytes() for c in cuts], pa.binary()),
                pa.array([times[c].astype("<u4").tobytes() for c in cuts], pa.binary()),
            ],
            names=["segment", "places", "times"],
        )


def _summed(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Per segment, whose rows follow each other: the logarithms of its counts, a byte each."""
    size = min(counters, 1 << SEGMENT_BITS)
    held, count = None, np.zeros(size)

    def done():
        steps = np.minimum(255, 8 * np.log2(count + 1)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([steps.tobytes()])], names=["segment", "counts"])

    for batch in batches:
        for segment, places, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if segment != held:
                if held is not None:
                    yield done()
                held, count = segment, np.zeros(size)
            count[np.frombuffer(places, "<u4")] += np.frombuffer(times, "<u4")
    if held is not None:
        yield done()


def rarity(texts: DataFrame, width: int, most: int = MOST_COUNTERS) -> np.ndarray:
    """A table of counters, a byte each, that tells common shingles from rare ones.

    Its size grows with the text up to ``most`` bytes, which is also all that comes to the driver. Shingles
    that share a counter are taken for as common as both together.
    """
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    counters = min(most, max(1 << 16, 1 << (chars // 6).bit_length()))
    partial = texts.select("node", "text").mapInArrow(
        in_tasks(_counted, width, counters), "segment int, places binary, times binary"
    )
    dealt = partial.repartition("segment").sortWithinPartitions("segment")
    table, size = np.zeros(counters, np.uint8), min(counters, 1 << SEGMENT_BITS)
    for segment, counts in dealt.mapInArrow(in_tasks(_summed, counters), "segment int, counts binary").collect():
        table[segment * size : (segment + 1) * size] = np.frombuffer(counts, np.uint8)
    return table


def shown(shingles: np.ndarray, weights: np.ndarray, table: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles a text shows, rare ones first, and the share of its weight that stands before each."""
    common = table[(shingles & np.uint64(len(table) - 1)).astype(np.int64)]
    order = np.lexsort((shingles, common))
    held = weights[order]
    before = (np.cumsum(held) - held) / held.sum()
    first = before <= 1 - threshold + 1e-9
    return shingles[order][first], before[first]


def _shown_rows(batches: Iterator[pa.RecordBatch], width: int, threshold: float, table) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        nodes, found = part.column(0).to_pylist(), []
        for node, text in zip(nodes, texts, strict=True):
            own = weighted(text, width)
            if len(own[0]):
                first, before = shown(*own, table.value, threshold)
                found.append((np.full(len(first), node), first.view(np.int64), before, len(own[0]), int(own[1].sum())))
        if found:
            repeats = [len(x[0]) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(np.concatenate([x[i] for x in found])) for i in range(3)),
                    *(pa.array(np.repeat([x[i] for x in found], repeats)) for i in (3, 4)),
                ],
                names=["node", "shingle", "before", "size", "total"],
            )


def reachable(threshold: float, a: str, b: str) -> Column:
    """Whether two texts can be as similar as the threshold, if this is the first shingle they share.

    With shares ``p`` and ``q`` of their weight on shingles that the other lacks, the similarity is at most
    (1 - p)(1 - q) / (1 - pq). Where nothing repeats, both share the same number of shingles, so that it is
    at most the Jaccard similarity with the smaller number that either has left.
    """
    n = {x: F.col(f"{x}.size") for x in (a, b)}
    left = {x: 1 - F.col(f"{x}.before") for x in (a, b)}
    weak = left[a] * left[b] >= (threshold - 1e-9) * (1 - F.col(f"{a}.before") * F.col(f"{b}.before"))
    plain = (n[a] == F.col(f"{a}.total")) & (n[b] == F.col(f"{b}.total"))
    shared = F.least(n[a] * left[a], n[b] * left[b])
    return weak & (~plain | (shared * (1 + threshold) >= (threshold - 1e-9) * (n[a] + n[b])))


def candidates(texts: DataFrame, classes: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs (pivot, node) of different classes among ``texts`` that are not proven apart."""
    table = texts.sparkSession.sparkContext.broadcast(rarity(texts, width))
    rows = texts.select("node", "text").mapInArrow(
        in_tasks(_shown_rows, width, threshold, table), "node long, shingle long, before double, size long, total long"
    )
    rows = staged(_with_class(rows, classes, "node"))
    held = rows.groupBy("shingle", "node_class").agg(F.count(F.lit(1)).alias("n"))
    tops = held.groupBy("shingle").agg(F.max_by("node_class", F.struct("n", "node_class")).alias("top"), F.count(F.lit(1)).alias("n"))
    both = staged(rows.join(tops.filter("n > 1").drop("n"), "shingle"))
    # of any two classes that show a shingle, one is not the largest
    few = both.filter("node_class <> top").alias("a")
    every = both.alias("b")
    once = (F.col("b.node_class") == F.col("b.top")) | (F.col("a.node") < F.col("b.node"))
    apart = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.node_class") != F.col("b.node_class")) & once
    found = few.join(every, apart & reachable(threshold, "a", "b"))
    return found.select(F.least("a.node", "b.node").alias("pivot"), F.greatest("a.node", "b.node").alias("node")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b) by large and small stars: node, class (its smallest node)."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = staged(edges.distinct())
    while True:
        # done once every node has one edge, to a node that has none
        ends = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        tops = edges.select(F.col("v").alias("u"), F.lit(True).alias("top")).distinct()
        if ends.join(tops, "u", "left").filter("n > 1 or top").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def merged_classes(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes after further links, which are followed from class to class only."""
    if classes is None:
        return components(links)
    ends = _with_class(_with_class(links, classes, "a"), classes, "b")
    moved = components(ends.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")))
    onward = moved.select(F.col("node").alias("class"), F.col("class").alias("__to"))
    kept = classes.join(onward, "class", "left").select("node", F.coalesce("__to", "class").alias("class"))
    return staged(kept.unionByName(moved))


def find_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    bands: int = 30,
    rows: int = 5,
) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), class_size, kept.

    Words are runs of characters other than ASCII white space, as written. A text of fewer than
    ``width`` words has one shingle, all its words; texts without words (null and empty ones too)
    are one class. Texts with the same weighted shingles are one node, known by a 64-bit hash. Rows
    without an id come after all others. Of repeated rows one is kept. Empty table: no rows.
    """
    found = staged(marks(docs, width, bands, rows, id_col, text_col))
    nodes = found.groupBy("node").agg(F.min(F.struct("doc_id", "x")).alias("row"), F.first("bands").alias("bands"))
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    several = buckets.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = staged(buckets.join(several, "band").select("band", "node", "pivot"))
    pivots = shared.select("band", "pivot").distinct()
    open_rows = shared.select("band", "node")

    chosen = nodes.join(shared.select("node").distinct(), "node").select("node", "row.doc_id", "row.x")
    text = docs.select(docs[id_col].alias("__id"), text_of(text_col).alias("text"))
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("x"))
    # repeated rows would bring a text twice
    texts = staged(text.join(chosen, same).groupBy("node").agg(F.first("text").alias("text")))

    done = classes = None
    for later in (False, True):
        met = open_rows.join(pivots, "band").filter("node <> pivot")
        pairs = met.select(F.least("node", "pivot").alias("pivot"), F.greatest("node", "pivot").alias("node")).distinct()
        if later:
            pairs = _apart(pairs, classes).join(done, ["pivot", "node"], "left_anti")
        fresh = staged(verified(pairs, texts, width, threshold))
        classes = merged_classes(classes, _links(fresh))
        done = fresh if done is None else done.unionByName(fresh)
        used = pivots.select("band", F.col("pivot").alias("node"))
        left = open_rows.select("band", "node").join(used, ["band", "node"], "left_anti")
        open_rows = staged(_mixed(_with_class(left, classes, "node")))
        degree = _links(done).select(F.explode(F.array("a", "b")).alias("node"))
        degree = degree.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        most = F.max_by("node", F.struct(F.coalesce("degree", F.lit(0)), "node"))
        pivots = open_rows.join(degree, "node", "left").groupBy("band").agg(most.alias("pivot"))
    left = staged(texts.join(open_rows.select("node").distinct(), "node", "left_semi"))
    pairs = candidates(left, classes, width, threshold).join(done, ["pivot", "node"], "left_anti")
    classes = merged_classes(classes, _links(staged(verified(pairs, texts, width, threshold))))

    counted = found.groupBy("node", "doc_id", "x").agg(F.count(F.lit(1)).alias("rows"))
    member = staged(_with_class(counted, classes, "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "x"))
    whole = member.groupBy("node_class").agg(first.alias("keep"), F.sum("rows").alias("class_size"))
    nth = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    keeps = (
        F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
        & (F.col("node") == F.col("keep.node"))
        & (F.col("x") == F.col("keep.x"))
        & (F.col("nth") == 1)
    )
    return (
        member.join(whole, "node_class")
        .withColumn("nth", nth)
        .select("doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", keeps.alias("kept"), F.col("x").alias("text_hash"))
    )


def _links(compared: DataFrame) -> DataFrame:
    return compared.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (band, node) of the buckets that hold several classes."""
    found = rows.groupBy("band").agg(F.min("node_class").alias("__a"), F.max("node_class").alias("__b"))
    return rows.select("band", "node").join(found.filter("__a <> __b").select("band"), "band")


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ends are of different classes."""
    ends = _with_class(_with_class(pairs, classes, "node"), classes, "pivot")
    return ends.filter("node_class <> pivot_class").select("pivot", "node")


def _with_class(rows: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    names = classes.select(F.col("node").alias(column), F.col("class").alias(f"__{column}"))
    joined = rows.join(names, column, "left")
    return joined.withColumn(f"{column}_class", F.coalesce(f"__{column}", column)).drop(f"__{column}")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that ``find_near_copies`` keeps, one of each class, with all their columns."""
    found = staged(find_near_copies(docs, id_col, text_col, **how))
    chosen = found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__x"))
    marked = docs.withColumn("__x", F.xxhash64(text_of(text_col))).withColumn("__id", F.col(id_col))
    same = marked["__id"].eqNullSafe(chosen["__id"]) & (marked["__x"] == chosen["__x"])
    left = marked.join(chosen, same, "left_semi")
    others = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__x"))
    repeated = chosen.join(others, chosen["__id"].eqNullSafe(others["__id"]) & (chosen["__x"] == others["__x"]), "left_semi")
    if not repeated.isEmpty():
        left = left.dropDuplicates(["__id", "__x"])
    return left.drop("__id", "__x")
