"""Language by rank-order profiles: the out-of-place distance of a text's most frequent n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import id_field, in_tasks, slices, text_of

UNDETERMINED = "und"
_EDGE = 1  # stands for the border of a word; no letter has this code point
_BITS = 21  # of a code point
# Distinct n-grams of one language a task holds before it hands on their counts.
_HELD = 500_000


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Codes of the 1-, 2- and 3-grams of a text's words, lower-cased, with word borders; letters only."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    marked = np.where(letter, points, _EDGE).astype(np.uint64)
    marked = np.concatenate(([np.uint64(_EDGE)], marked, [np.uint64(_EDGE)]))
    edge = marked == _EDGE
    marked = marked[np.concatenate(([True], ~(edge[1:] & edge[:-1])))]
    edge = marked == _EDGE
    two = marked[:-1] | marked[1:] << np.uint64(_BITS)
    three = two[:-1] | marked[2:] << np.uint64(2 * _BITS)
    return np.concatenate((marked[~edge], two, three[~edge[1:-1]]))


def profile(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.lexsort((found, -counts))[:size]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}

    def given(lang: str) -> pa.RecordBatch:
        codes = np.concatenate([x[0] for x in held[lang]])
        counts = np.concatenate([x[1] for x in held.pop(lang)])
        found, at = np.unique(codes, return_inverse=True)
        sums = np.bincount(at, counts).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(sums)],
            names=["lang", "code", "n"],
        )

    for part, texts in slices(batches):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, group in by_lang.items():
            found = np.unique(ngrams("\n".join(group)), return_counts=True)
            if len(found[0]):
                held.setdefault(lang, []).append(found)
                if sum(len(x[0]) for x in held[lang]) > _HELD:
                    yield given(lang)
    for lang in list(held):
        yield given(lang)


def learn(docs: DataFrame, size: int = 400, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Profiles of the languages over all rows: lang, code, rank (from 0). Rows without language are left out."""

    known = docs.filter(docs[lang_col].isNotNull()).select(
        docs[lang_col].cast("string").alias("lang"), text_of(text_col).alias("text")
    )
    sums = known.mapInArrow(in_tasks(_counted), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    # the filter stands on row_number itself, so that each task hands on ``size`` rows of a language at most
    ranked = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    return ranked.select("lang", "code", (F.col("rank") - 1).alias("rank"))


def verdict(text: str, langs: list[str], codes: np.ndarray, ranks: np.ndarray, size: int) -> tuple[str, float]:
    own = profile(ngrams(text), size)
    if not len(own) or not langs:
        return UNDETERMINED, 0.0
    at = np.searchsorted(codes, own)
    at[at >= len(codes)] = 0
    at[codes[at] != own] = len(codes)
    found = ranks[at]
    away = np.abs(found - np.arange(len(own), dtype=np.int32)[:, None])
    away[found >= size] = size
    distance = np.minimum(away, size).sum(axis=0)
    best = int(np.argmin(distance))
    return langs[best], float(1 - distance[best] / (size * len(own)))


def _predicted(batches: Iterator[pa.RecordBatch], names: list[str], model, size: int) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        found = [verdict(x, *model.value, size) for x in texts]
        langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
        yield pa.RecordBatch.from_arrays([part.column(0), langs, scores], names=names)


def predict(
    docs: DataFrame, profiles: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, lang_pred, score (1: all n-grams in place, 0: none in the profile).

    The profiles are languages times ``size`` rows, which the driver holds and sends to the tasks.
    The distance sums, over the text's ``size`` most frequent n-grams, how far each rank is from the
    profile's, at most ``size``. The smallest distance wins, ties the first language by code point.

    Null text, text without a letter, and any text if no profile was learned: ``und`` with score 0.
    Whole texts count. Repeated rows: one result each. Empty table: no rows.
    """
    rows = profiles.toPandas()
    langs = sorted(rows["lang"].unique(), key=lambda x: x.encode())
    codes = np.unique(rows["code"].to_numpy().astype(np.int64).view(np.uint64)) if len(rows) else np.empty(0, np.uint64)
    ranks = np.full((len(codes) + 1, max(1, len(langs))), size, np.int32)
    if len(rows):
        at = np.searchsorted(codes, rows["code"].to_numpy().astype(np.int64).view(np.uint64))
        ranks[at, [langs.index(x) for x in rows["lang"]]] = rows["rank"].to_numpy()
    model = docs.sparkSession.sparkContext.broadcast((langs, codes, ranks))

    schema = T.StructType(
        [id_field(docs, id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        in_tasks(_predicted, schema.names, model, size), schema
    )
