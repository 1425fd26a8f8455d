"""Exact copies: local combining, a merge of salted digest groups, a merge of the salts' winners.

Texts are equal when they are identical after each run of white space is replaced by one blank.
Every stage groups by the digest *and* the whole normalised text, so different texts of one digest
stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import SPACE_RUN, text_of
from caseflow.sources.sinks import staged


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACE_RUN, " ")


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    content = normalised(text_col)
    return docs.select(docs[id_col].alias("doc_id"), content.alias("content")).withColumn(
        "digest", digest(F.col("content"))
    )


def copy_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 8,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per different text: digest, content, keep_id, group_size; dealt by digest.

    The first aggregation combines the copies of each task before anything is sent, then merges them
    by (digest, salt, text); the salt comes from the id, so a group of any size is dealt over
    ``salts`` tasks. The second merges the at most ``salts`` winners of each text.
    """
    salted = (
        _rows(docs, id_col, text_col, digest)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    )
    return (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )


def find_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 8,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    Of equal texts the row with the smallest id stays. Null text counts as empty. Rows without an id
    come after all others; a group of such rows keeps one, with a null keep_id. Of repeated rows
    (equal id and text) one is kept. Empty table: no rows.
    """
    groups = copy_groups(docs, id_col, text_col, salts, digest)
    texts = staged(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"),
            F.min("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        )
    )
    rows = _rows(docs, id_col, text_col, digest)
    single = texts.filter("texts = 1").drop("texts")
    # Repeated rows fall together before the join and are written out again after it.
    found = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("rows")).join(single, "digest")
    several = texts.filter("texts > 1").select("digest")
    if not several.isEmpty():  # different texts of one digest: told apart by the text itself
        apart = rows.join(several, "digest", "left_semi").groupBy("digest", "content", "doc_id")
        found = found.unionByName(
            apart.agg(F.count(F.lit(1)).alias("rows"))
            .join(groups.join(several, "digest", "left_semi"), ["digest", "content"])
            .drop("content")
        )
    nth = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return found.withColumn("nth", nth).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "digest",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """The rows of ``docs`` that ``find_copies`` keeps, with all their columns."""
    kept = staged(find_copies(docs, id_col, text_col, salts))
    chosen = kept.filter("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    marked = docs.withColumn("__digest", sha256(normalised(text_col))).withColumn("__id", F.col(id_col))
    same = marked["__id"].eqNullSafe(chosen["__id"]) & (marked["__digest"] == chosen["__digest"])
    left = marked.join(chosen, same, "left_semi")
    repeated = kept.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not repeated.isEmpty():
        left = left.dropDuplicates(["__id", "__digest"])
    return left.drop("__id", "__digest")
