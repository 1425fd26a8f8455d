"""An index of vectors: cells around centres, with bounds on what a cell can hold for a query.

Vectors are taken at length one, where a higher cosine is a smaller distance. A cell knows the radius
that holds all its vectors, so by the triangle inequality none of them is nearer to a query than the
distance to the centre less the radius. The centres only decide how much a search can leave out; any
centres give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.sources.sinks import staged

# Bounds of what the centres are fitted on, and of their number, which the driver and every task hold.
SAMPLE_ROWS = 8192
CELLS = 1024
ROUNDS = 5
# Vectors of length zero have no direction; they stand in a cell of their own.
NO_CELL = -1
# A query that the bounds leave this marks as one to meet all letters.
ALL_CELLS = -2
# Scores are compared with this much room for the rounding of sums.
SLACK = 1e-8
# Queries placed at a time, and rows handed on at a time, which bound what a task holds.
PLACED_ROWS = 1024
SENT_ROWS = 32_768


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


@dataclass(frozen=True)
class Index:
    """``rows``: (letter_id, _vector, _cell); of each centre its radius and how many letters its cell holds."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def centres_of(letters: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres by a few rounds of k-means over at most ``sample_rows`` letters, in the order of a hash."""
    order = [F.xxhash64("letter_id"), F.col("letter_id")]
    sample = letters.orderBy(*order).limit(sample_rows).select("embedding").toPandas()
    m = unit(sample["embedding"])
    m = m[np.abs(m).sum(axis=1) > 0]
    centres = m[:cells].copy()
    for _ in range(ROUNDS):
        near = np.argmax(m @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        for c in np.unique(near):
            centres[c] = m[near == c].mean(axis=0)
    return centres


def build(letters: DataFrame, n_letters: int, sample_rows: int = SAMPLE_ROWS, cells: int | None = None) -> Index:
    """Every letter in the cell of its nearest centre; about as many cells as a cell has letters."""
    centres = centres_of(letters, cells or int(min(CELLS, max(1, n_letters**0.5))), sample_rows)
    turned = unit

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = turned(batch["embedding"])
            zero = np.abs(m).sum(axis=1) == 0
            gap = np.zeros((len(m), 1)) if not len(centres) else (centres**2).sum(axis=1) / 2 - m @ centres.T
            near = np.argmin(gap, axis=1)
            away = np.linalg.norm(m - centres[near], axis=1) if len(centres) else np.zeros(len(m))
            yield pd.DataFrame(
                {"letter_id": batch["letter_id"], "_vector": batch["embedding"], "_cell": np.where(zero, NO_CELL, near), "_away": away}
            )

    schema = T.StructType(
        [
            letters.schema["letter_id"],
            T.StructField("_vector", letters.schema["embedding"].dataType),
            T.StructField("_cell", T.IntegerType()),
            T.StructField("_away", T.DoubleType()),
        ]
    )
    rows = staged(letters.select("letter_id", "embedding").mapInPandas(assigned, schema))
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    # at most one row for each centre and one more
    for cell, away, n in rows.groupBy("_cell").agg(F.max("_away"), F.count("*")).collect():
        if cell != NO_CELL:
            radius[cell], count[cell] = away, n
    return Index(rows.drop("_away"), centres, radius, count)


def visits(queries: DataFrame, index: Index, k: int, later: bool, most: int | None = None) -> DataFrame:
    """The cells a query looks into: (query_id, _vector, _cell), later with its ``_least`` as well.

    At first the nearest cells that hold ``k`` letters. Later, with the least score of its best ``k`` so far
    as ``_least`` (null if it has fewer), all other cells that may hold a better one. Those of more than
    ``most`` cells stand as the one row ``ALL_CELLS``: the bounds spare such a query too little.
    """
    centres, radius, count, turned, slack = index.centres, index.radius, index.count, unit, SLACK
    placed_rows, sent_rows, all_cells = PLACED_ROWS, SENT_ROWS, ALL_CELLS

    def looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), placed_rows):
                batch = whole.iloc[start : start + placed_rows]
                row, cell, least = places(batch)
                ids, own = batch["query_id"].to_numpy(), batch["embedding"].to_numpy()
                for i in range(0, len(row), sent_rows):
                    part = row[i : i + sent_rows]
                    sent = pd.DataFrame({"query_id": ids[part], "_vector": own[part], "_cell": cell[i : i + sent_rows]})
                    yield sent.assign(_least=least[part]) if later else sent

    def places(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        m, least = turned(batch["embedding"]), None
        squares = (m**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * m @ centres.T
        away = np.sqrt(np.maximum(squares, 0))
        order = np.argsort(away, axis=1, kind="stable")
        held = np.cumsum(count[order], axis=1) - count[order]
        chosen = np.zeros(away.shape, bool)
        np.put_along_axis(chosen, order, held < k, axis=1)
        if later:
            least = batch["_least"].to_numpy(dtype=np.float64, na_value=-2.0)
            least = np.where(np.isnan(least), -2.0, least)
            best = 1 - np.maximum(away - radius[None, :] - slack, 0) ** 2 / 2
            chosen = ~chosen & (best >= least[:, None] - slack)
        chosen &= (count > 0)[None, :] & (np.abs(m).sum(axis=1) > 0)[:, None]
        wide = np.zeros(0, np.int64)
        if most is not None:
            wide = np.flatnonzero(chosen.sum(axis=1) > most)
            chosen[wide] = False
        row, cell = np.nonzero(chosen)
        cell = np.concatenate([cell, np.full(len(wide), all_cells)]).astype(np.int32)
        return np.concatenate([row, wide]), cell, least

    fields = [
        queries.schema["query_id"],
        T.StructField("_vector", queries.schema["embedding"].dataType),
        T.StructField("_cell", T.IntegerType()),
    ]
    if later:
        fields.append(T.StructField("_least", T.DoubleType()))
    return queries.mapInPandas(looked, T.StructType(fields))
