"""Nearest past letters by cosine, and retrieval by shared signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.values import fixed
from caseflow.operators import vectors
from caseflow.operators.windows import top_per
from caseflow.sources.sinks import staged

THRESHOLD = 0.7
# Letters and queries of a block. Each side of a cell is sent once per block of the other.
BLOCK_ROWS = 8192
# Of a block so many queries are scored at a time, which bounds the matrix of scores.
CHUNK_ROWS = 256
# Cells a query looks into after its first ones; one that the bounds leave more meets all letters, in wider blocks.
LOOKS = 32
WIDER = 4
# Scores are compared to this many digits, so that the order of additions cannot reorder matches.
DIGITS = 9


def _scored(k: int, exclude_same: bool, chunk_rows: int = CHUNK_ROWS):
    """Best ``k`` of one block of letters for each query of one block of queries.

    Of queries with a ``_least`` only letters that reach it count, so few scores are looked at twice.
    """

    def matrix(vectors: pd.Series) -> np.ndarray:
        m = np.asarray(vectors.tolist(), dtype=np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

    def score(queries: pd.DataFrame, letters: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or letters.empty:
            return pd.DataFrame({"query_id": [], "letter_id": [], "score": []})
        own, theirs = matrix(queries["_vector"]), matrix(letters["_vector"]).T
        q_ids, l_ids = queries["query_id"].to_numpy(), letters["letter_id"].to_numpy()
        least = queries["_least"].to_numpy() if "_least" in queries else None
        chunks = [slice(i, i + chunk_rows) for i in range(0, len(own), chunk_rows)]
        return pd.concat([best(own[c], theirs, q_ids[c], l_ids, None if least is None else least[c]) for c in chunks])

    def best(own: np.ndarray, theirs: np.ndarray, q_ids: np.ndarray, l_ids: np.ndarray, least: np.ndarray | None) -> pd.DataFrame:
        scores = own @ theirs
        if least is None:
            scores = np.round(scores, DIGITS)
            if exclude_same:
                scores[q_ids[:, None] == l_ids[None, :]] = -np.inf
            n = min(k, scores.shape[1])
            least = np.partition(scores, -n, axis=1)[:, -n]
            row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        else:
            row, col = np.nonzero(scores >= (least - 10.0**-DIGITS)[:, None])
            if exclude_same:
                other = q_ids[row] != l_ids[col]
                row, col = row[other], col[other]
        found = pd.DataFrame(
            {"_row": row, "letter_id": l_ids[col], "score": np.round(scores[row, col], DIGITS)}
        ).sort_values(["_row", "score", "letter_id"], ascending=[True, False, True])
        found = found.groupby("_row", sort=False).head(k)
        found["query_id"] = q_ids[found["_row"].to_numpy()]
        return found[["query_id", "letter_id", "score"]]

    return score


def top_matches(
    queries: DataFrame,
    letters: DataFrame,
    k: int = 10,
    exclude_same: bool = False,
    block_rows: int = BLOCK_ROWS,
    **index,
) -> DataFrame:
    """The ``k`` letters of highest cosine for each query, exactly.

    ``queries``: ``(query_id, embedding)``, ``letters``: ``(letter_id, embedding)``. Letters that fit one
    block meet each block of queries in one matrix product; no row pairs are formed, and a query is sent
    once. More letters than that are searched through an index (``indexed_matches``, which ``index`` is
    for). Letters and queries without a vector take no part; ties go to the lower letter id.
    """
    queries = queries.filter(F.col("embedding").isNotNull())
    letters = letters.filter(F.col("embedding").isNotNull())
    n_letters = letters.count()
    if n_letters > block_rows:
        return indexed_matches(queries, letters, n_letters, k, exclude_same, block_rows, **index)
    one = F.lit(0).alias("_cell")
    q = queries.select("query_id", F.col("embedding").alias("_vector"), one)
    s = letters.select("letter_id", F.col("embedding").alias("_vector"), one)
    return _ranked(_met(q, s, k, exclude_same, block_rows), k)


def indexed_matches(
    queries: DataFrame,
    letters: DataFrame,
    n_letters: int,
    k: int,
    exclude_same: bool = False,
    block_rows: int = BLOCK_ROWS,
    looks: int = LOOKS,
    **index,
) -> DataFrame:
    """The same through cells of letters (``vectors.build``).

    A query looks into its nearest cells first. Its least score there then proves which other cells cannot
    hold a better letter, and it looks into the rest. So letters are sent to their cell, queries to the
    cells that matter to them. A query left with more than ``looks`` cells, as where letters lie in no
    groups, is not sent to each of them: it meets all letters in blocks. Of letters without direction, whose score is 0 for all, and of all letters
    for a query without direction the lowest ids are enough.
    """
    held = vectors.build(letters, n_letters, **index)
    more = k + 1 if exclude_same else k
    cells = held.rows.filter(F.col("_cell") != vectors.NO_CELL)
    first = staged(_met(staged(vectors.visits(queries, held, more, False)), cells, k, exclude_same, block_rows))
    least = _ranked(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    asked = queries.join(least, "query_id", "left")
    rest = staged(vectors.visits(asked, held, more, True, looks))
    wide = rest.filter(F.col("_cell") == vectors.ALL_CELLS)
    second = _met(rest.filter(F.col("_cell") != vectors.ALL_CELLS), cells, k, exclude_same, block_rows)
    whole = _met(wide, cells.withColumn("_cell", F.lit(vectors.ALL_CELLS)), k, exclude_same, WIDER * block_rows)
    # what meets all letters meets those of its first cells again
    first = first.join(wide.select("query_id"), "query_id", "left_anti")

    def lowest(rows: DataFrame):
        """At most ``more`` ids."""
        return rows.orderBy("letter_id").limit(more).agg(F.collect_list("letter_id").alias("ids")).scalar()

    turned = F.exists("embedding", lambda x: x != 0)
    flat = queries.select(
        "query_id",
        F.explode(F.when(turned, lowest(held.rows.filter(F.col("_cell") == vectors.NO_CELL))).otherwise(lowest(held.rows))).alias("letter_id"),
        F.lit(0.0).alias("score"),
    )
    if exclude_same:
        flat = flat.filter(F.col("query_id") != F.col("letter_id"))
    return _ranked(first.unionByName(second).unionByName(whole).unionByName(flat), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_per(found, ["query_id"], [F.col("score").desc(), F.col("letter_id")], k, rank="rank")


def _met(visits: DataFrame, letters: DataFrame, k: int, exclude_same: bool, block_rows: int) -> DataFrame:
    """The best ``k`` of each cell for the queries that visit it.

    A cell is cut into blocks of letters and of queries by their ids, and each pair of blocks is one group,
    so a cell of any size is dealt over many tasks. What says into how many is one row per cell.
    """

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("_cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    # at most vectors.CELLS rows
    counts = F.broadcast(sizes(letters, "_n_lb").join(sizes(visits, "_n_qb"), "_cell"))

    def spread(rows: DataFrame, id_: str, own: str, other: str) -> DataFrame:
        return rows.join(counts, "_cell").select(
            id_,
            "_vector",
            *[c for c in rows.columns if c == "_least"],
            "_cell",
            F.pmod(F.xxhash64(id_), F.col(f"_n{own}")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)).alias(other),
        )

    keys = ["_cell", "_qb", "_lb"]
    q = spread(visits, "query_id", "_qb", "_lb").groupBy(*keys)
    s = spread(letters, "letter_id", "_lb", "_qb").groupBy(*keys)
    schema = T.StructType([visits.schema["query_id"], letters.schema["letter_id"], T.StructField("score", T.DoubleType())])
    return q.cogroup(s).applyInPandas(_scored(k, exclude_same), schema)


def best_match(
    queries: DataFrame,
    letters: DataFrame,
    threshold: float = THRESHOLD,
    default_letter: str | int | None = None,
    **options,
) -> DataFrame:
    """Each query's best letter, or the default with score 0 below the threshold.

    A letter must be more than not similar: a score of 0 or less never matches.
    """
    top = top_matches(queries, letters, 1, **options).filter("score > 0")
    joined = queries.select("query_id").join(top, "query_id", "left")
    good = F.coalesce(F.col("score") >= threshold, F.lit(False))
    default = F.lit(default_letter).cast(letters.schema["letter_id"].dataType)
    return joined.select(
        "query_id",
        F.when(good, F.col("letter_id")).otherwise(default).alias("letter_id"),
        F.when(good, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        (~good).alias("is_default"),
    )


def matches_with_reason(
    queries: DataFrame, letters: DataFrame, k: int = 10, threshold: float = THRESHOLD, **options
) -> DataFrame:
    """Top ``k`` per query; a query whose best score is too low says why it falls back."""
    top = top_matches(queries, letters, k, **options)
    best = top.groupBy("query_id").agg(
        F.max("score").alias("best_score"), F.count("*").alias("n_matches")
    )
    reason = F.when(
        F.col("best_score").isNull(), F.lit("No gold letters have embeddings")
    ).when(
        F.col("best_score") < threshold,
        F.concat(
            F.lit("Best match score ("),
            fixed(F.col("best_score"), 2),
            F.lit(f") below threshold ({threshold})"),
        ),
    )
    summary = queries.select("query_id").join(best, "query_id", "left")
    return (
        summary.select(
            "query_id",
            F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
            reason.isNotNull().alias("use_fallback"),
            reason.alias("fallback_reason"),
        )
        .join(top, "query_id", "left")
    )


def retrieve_criteria(requests: DataFrame, criteria: DataFrame, k: int = 5) -> DataFrame:
    """Up to ``k`` criteria per request that share a signal with it, by criteria id.

    ``requests``: ``(request_id, signals)``, ``criteria``: ``(criteria_id, relevance, …)``. For each
    signal only its first ``k`` criteria can be among the first ``k`` of a request, so criteria are
    cut to ``k`` per signal before they meet a request: a common signal brings ``k`` rows, not all.
    A request without signals is open to every criterion.
    """
    by_signal = criteria.select("criteria_id", F.explode("relevance").alias("signal")).distinct()
    first = top_per(by_signal, ["signal"], [F.col("criteria_id")], k)
    asked = requests.select("request_id", F.explode("signals").alias("signal")).distinct()
    hits = asked.join(first, "signal").select("request_id", "criteria_id").distinct()
    open_requests = requests.filter(F.coalesce(F.size("signals"), F.lit(0)) <= 0)
    # the first k criteria of all, as one array of at most k ids
    head = criteria.select("criteria_id").orderBy("criteria_id").limit(k)
    ids = head.agg(F.array_sort(F.collect_list("criteria_id")).alias("ids")).scalar()
    opened = open_requests.select("request_id", F.explode(ids).alias("criteria_id"))
    return top_per(
        hits.unionByName(opened), ["request_id"], [F.col("criteria_id")], k, rank="rank"
    )
