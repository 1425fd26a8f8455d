"""Checks of tables, files and profiles, as result rows; and audits of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.text import NO_NOTE
from caseflow.functions.values import any_of


def missing_columns(rows: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected columns the table lacks; reads the schema only."""
    return sorted(set(expected) - set(rows.columns))


def check_table(
    rows: DataFrame, name: str, expected: Sequence[str] = (), min_rows: int = 1
) -> DataFrame:
    """One row: count, missing columns, verdict."""
    missing = ", ".join(missing_columns(rows, expected))
    counted = rows.agg(F.count("*").alias("n_rows"))
    return counted.select(
        F.lit(name).alias("check_name"),
        "n_rows",
        F.lit(missing).alias("missing_columns"),
        ((F.col("n_rows") >= min_rows) & F.lit(not missing)).alias("passed"),
    )


def watched(rows: DataFrame, columns: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """The rows, and what will be known of them once they are written: their count and the values per column.

    Write the rows as they are: measured right in front of a sink, each row is counted once, and the table
    need not be read again to be checked.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in columns]]
    return rows.observe(seen, *counts), seen


def check_watched(
    rows: DataFrame, seen: Observation, name: str, expected: Sequence[str] = (), min_rows: int = 1
) -> DataFrame:
    """As ``check_table`` for rows of ``watched`` that were written."""
    missing, n_rows = ", ".join(missing_columns(rows, expected)), seen.get["n_rows"]
    return rows.sparkSession.range(1).select(
        F.lit(name).alias("check_name"),
        F.lit(n_rows).cast("long").alias("n_rows"),
        F.lit(missing).alias("missing_columns"),
        F.lit(n_rows >= min_rows and not missing).alias("passed"),
    )


def watched_counts(rows: DataFrame, seen: Observation) -> DataFrame:
    """One row of ``watched``: n_rows, and n_<column> for each column counted."""
    return rows.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in seen.get.items()])


def check_named_table(
    spark: SparkSession, name: str, expected: Sequence[str] = (), min_rows: int = 1
) -> DataFrame:
    """As ``check_table``; a table that does not exist fails."""
    if not spark.catalog.tableExists(name):
        return spark.range(1).select(
            F.lit(name).alias("check_name"),
            F.lit(0).cast("long").alias("n_rows"),
            F.lit(", ".join(expected)).alias("missing_columns"),
            F.lit(False).alias("passed"),
        )
    return check_table(spark.table(name), name, expected, min_rows)


def check_files(
    files: DataFrame, name: str, extension: str, min_files: int = 1
) -> DataFrame:
    """One row for a file listing ``(path, …)``: files of the extension against the least number."""
    n = F.count_if(F.lower("path").endswith(extension.lower()))
    return files.agg(n.alias("n_rows")).select(
        F.lit(name).alias("check_name"),
        "n_rows",
        F.lit("").alias("missing_columns"),
        (F.col("n_rows") >= min_files).alias("passed"),
    )


def files_by_extension(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n_files"))


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def check_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count_if("passed").alias("n_passed"),
        F.count("*").alias("n_checks"),
        F.every("passed").alias("all_passed"),
    )


# --- audits -----------------------------------------------------------------------------------


def fill_counts(rows: DataFrame, columns: dict[str, str], flags: dict[str, Column] | None = None):
    """Row count, non-null count per column and count of true per flag, in one pass."""
    return rows.agg(
        F.count("*").alias("total_rows"),
        *[F.count(c).alias(alias) for alias, c in columns.items()],
        *[F.count_if(c).alias(alias) for alias, c in (flags or {}).items()],
    )


def null_labels(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return rows.select(
        key, *[F.when(F.col(c).isNull(), "NULL").otherwise("OK").alias(c) for c in columns]
    )


def missing_labels(
    rows: DataFrame, key: str, columns: Sequence[str], sentinel: str = NO_NOTE
) -> DataFrame:
    """OK or MISSING per column; a sentinel counts as missing."""
    return rows.select(
        key,
        *[
            F.when(any_of([F.col(c).isNull(), F.col(c) == sentinel]), "MISSING")
            .otherwise("OK")
            .alias(c)
            for c in columns
        ],
    )


def lengths(rows: DataFrame, keys: Sequence[str], texts: dict[str, str], arrays: dict[str, str]):
    """Length of text columns and size of array columns per row."""
    return rows.select(
        *keys,
        *[F.length(c).alias(alias) for alias, c in texts.items()],
        *[F.size(c).alias(alias) for alias, c in arrays.items()],
    )


def preview(
    rows: DataFrame, keys: Sequence[str], texts: Sequence[str], chars: int = 200, n: int = 3
) -> DataFrame:
    """The start of the first ``n`` rows by key: a look, not a result."""
    return (
        rows.select(*keys, *[F.left(c, F.lit(chars)).alias(f"{c}_preview") for c in texts])
        .orderBy(*keys)
        .limit(n)
    )


def vector_ends(rows: DataFrame, keys: Sequence[str], vector: str, last: int) -> DataFrame:
    """First and last element of each vector; null where the vector is shorter."""
    return rows.filter(F.col(vector).isNotNull()).select(
        *keys,
        F.try_element_at(vector, F.lit(1)).alias("first_val"),
        F.try_element_at(vector, F.lit(last)).alias("last_val"),
    )


def counts_by(rows: DataFrame, key: str, alias: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(alias))


def labelled_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts per key of several tables, each labelled with its name."""
    parts = [
        rows.groupBy(key)
        .agg(F.count("*").alias("count"))
        .select(F.lit(name).alias("source"), key, "count")
        for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def table_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of several tables in one row."""
    return spark.range(1).select(
        *[rows.agg(F.count("*")).scalar().alias(name) for name, rows in tables.items()]
    )
