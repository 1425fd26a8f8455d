"""Toxicity by class-conditional Kneser-Ney models.

Each class has a distribution of words by Kneser-Ney's continuation counts (after how many different
words a word occurs), with an absolute discount, which backs off to the continuation counts of both
classes together. Discount and weight of the backoff are the same probability in both classes, so an
expression that is rare, or as frequent as its class is large, moves neither. A text's
log-likelihoods are normalised by length and compared: over the whole text, over its most suspicious
passage, and over its most suspicious expression. A logistic calibration, on labelled rows that gave
no counts, turns the three into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import id_field, in_tasks, slices, text_of
from caseflow.llm.hashing import stretches
from caseflow.sources.sinks import staged

# Bound of the labelled sample: so many rows of each class at most, in the order of a hash of the id.
MAX_ROWS = 4000
PASSAGE = 10
# Of the sample, one row in so many gives the calibration and no counts.
HELD_BACK = 4
_START = np.uint64(0x5A5A5A5A5A5A5A5A)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(text: str) -> np.ndarray:
    """Hashes of the lower-cased runs of letters and digits (any character beyond ASCII counts as a letter)."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inside = np.concatenate(([False], _WORD[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return stretches(data, edges[::2], edges[1::2])


def features(text: str, words: np.ndarray, ratios: np.ndarray) -> tuple[float, float, float]:
    """Length-normalised log-likelihood ratios: of the text, its worst passage, its worst expression."""
    own = tokens(text)
    if not len(own) or not len(words):
        return 0.0, 0.0, 0.0
    at = np.searchsorted(words, own)
    at[at >= len(words)] = 0
    ratio = np.where(words[at] == own, ratios[at], 0.0)
    if len(ratio) > PASSAGE:
        sums = np.concatenate(([0.0], np.cumsum(ratio)))
        worst = (sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE
    else:
        worst = ratio.sum() / PASSAGE
    return float(ratio.mean()), float(worst), float(ratio.max())


def sample(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """Labelled training rows: toxic, held_back, text; at most ``max_rows`` of each class."""
    known = (
        labels.filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    # of each class every task hands on its first rows only
    first = [known.filter(is_it).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for is_it in ("toxic", "not toxic")]
    chosen = first[0].unionByName(first[1])
    held = F.pmod(F.xxhash64(F.lit("held back"), "doc_id"), F.lit(HELD_BACK)) == 0
    chosen = chosen.select(F.col("doc_id").alias("__id"), "toxic", held.alias("held_back"))
    # at most 2 * max_rows rows, so they fit in every task
    rows = docs.select(docs[id_col].alias("__id"), text_of(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), "__id").select("toxic", "text", "held_back")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        for toxic, text in zip(part.column(0).to_pylist(), texts, strict=True):
            own = tokens(text)
            if len(own):
                pairs = np.unique(np.stack([own, np.concatenate(([_START], own[:-1]))], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pairs[:, 0].copy().view(np.int64)),
                        pa.array(pairs[:, 1].copy().view(np.int64)),
                        pa.array([toxic] * len(pairs), pa.bool_()),
                    ],
                    names=["word", "before", "toxic"],
                )


def continuations(rows: DataFrame) -> DataFrame:
    """word (its hash), toxic, n: after how many different words each word occurs in a class."""

    pairs = rows.select("toxic", "text").mapInArrow(in_tasks(_contexts), "word long, before long, toxic boolean").distinct()
    return pairs.groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("n"))


def ratios(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words whose log-likelihoods differ between the classes, and by how much.

    The discount is Kneser-Ney's estimate out of the smaller class, n1 / (n1 + 2 n2) contexts, n1 and n2 being
    the words seen after one and after two different words; the larger class is discounted in proportion.
    Words whose counts are all discounted have the shared probability in both classes, a ratio of 0,
    and are not held. The others are no more than the contexts of the sample.
    """
    wide = counts.groupBy("word").agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("good"),
    )
    wide = staged(wide)
    bad, good, words = wide.agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
    if not bad or not good:
        return np.empty(0, np.uint64), np.empty(0)
    small = F.col("bad" if bad <= good else "good")
    once, twice = wide.agg(F.count_if(small == 1), F.count_if(small == 2)).first()
    off = (once + 0.5) / (once + 2.0 * twice + 1.0) / min(bad, good)
    least = F.least(F.col("bad") + F.col("good"), F.lit(off * (bad + good)))
    backoff = wide.agg(F.sum(least)).first()[0] / (bad + good)
    told = wide.filter((F.col("bad") / bad > off) | (F.col("good") / good > off)).toPandas()
    shared = backoff * (told["bad"] + told["good"] + 1.0) / (bad + good + words + 1.0)
    value = np.log(np.maximum(told["bad"] / bad - off, 0) + shared) - np.log(np.maximum(told["good"] / good - off, 0) + shared)
    hashes = told["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], value.to_numpy().astype(float)[order]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on (features, 1), lightly penalised; Newton steps."""
    if not len(y) or y.min() == y.max():
        return np.array([0.0] * x.shape[1] + [-4.0])
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - middle) / spread, np.ones(len(y))]
    weight, beta = weight / weight.mean(), np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(beta)), z.T @ (weight * (y - p)) - 0.1 * beta)
        beta = beta + np.clip(step, -5, 5)
    return np.append(beta[:-1] / spread, beta[-1] - (beta[:-1] * middle / spread).sum())


def _measured(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        found = np.array([features(x, *model.value) for x in texts]).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(x) for x in found.T)], names=["toxic", "a", "b", "c"]
        )


def _model(spark, docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, max_rows: int):
    """What scores a text: the broadcast ratios and the weights of the calibration."""
    rows = staged(sample(docs, labels, train, id_col, text_col, max_rows))
    model = spark.sparkContext.broadcast(ratios(continuations(rows.filter(~F.col("held_back")))))

    known = rows.filter("held_back").select("toxic", "text")
    known = known.mapInArrow(in_tasks(_measured, model), "toxic boolean, a double, b double, c double").toPandas()  # at most 2 * max_rows rows
    labelled = labels.filter(train & F.col("toxic").isNotNull())
    share = {r[0]: r[1] for r in labelled.groupBy((F.col("toxic") > 0).alias("k")).count().collect()}
    y = known["toxic"].to_numpy().astype(float)
    weight = np.array([share.get(bool(k), 0) / max(1, (y == k).sum()) for k in y])
    return model, calibrate(known[["a", "b", "c"]].to_numpy().astype(float), y, weight)


def _probabilities(texts: list[str], words: np.ndarray, ratio: np.ndarray, beta: np.ndarray) -> np.ndarray:
    x = np.array([(*features(t, words, ratio), 1.0) for t in texts]).reshape(-1, 4)
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def _scored(batches: Iterator[pa.RecordBatch], model, beta: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        found = pa.array(_probabilities(texts, *model.value, beta))
        yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "score"])


def _kept(batches: Iterator[pa.RecordBatch], names: list[str], model, beta: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches, text_at=len(names)):
        clean = pa.array(_probabilities(texts, *model.value, beta) < 0.5)
        yield pa.RecordBatch.from_arrays([c.filter(clean) for c in part.columns[:-1]], names=names)


def score(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Per document: doc_id, score (0 to 1), predicted (1 if the score is at least 0.5).

    ``labels`` has doc_id and toxic; ``train`` is a condition on its rows, of which the labels are
    learned, from at most ``max_rows`` rows of each class. Rows without id or label are left out; a
    document labelled twice is toxic if either label says so. Whole texts are scored.

    Null or empty text scores as a text of unknown words. Without labels of both classes all scores
    are alike and low. Repeated rows: one result each. Empty table: no rows.
    """
    model, beta = _model(docs.sparkSession, docs, labels, train, id_col, text_col, max_rows)
    schema = T.StructType([id_field(docs, id_col), T.StructField("score", T.DoubleType())])
    found = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        in_tasks(_scored, model, beta), schema
    )
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """The rows of ``docs`` whose text ``score`` does not predict toxic, with all their columns; no shuffle."""
    model, beta = _model(docs.sparkSession, docs, labels, train, id_col, text_col, max_rows)
    return docs.select("*", text_of(text_col).alias("__text")).mapInArrow(
        in_tasks(_kept, docs.columns, model, beta), docs.schema
    )
