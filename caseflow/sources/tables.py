"""Source tables by name, with separate places to read and to write."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Sources:
    """Names to tables. ``read`` and ``write`` are catalog prefixes such as ``prod.curated``."""

    spark: SparkSession
    read: str = ""
    write: str = ""

    @classmethod
    def from_environment(cls, spark: SparkSession) -> Sources:
        """Catalogs named by CASEFLOW_READ and CASEFLOW_WRITE; the current one where unset."""
        return cls(
            spark, os.environ.get("CASEFLOW_READ", ""), os.environ.get("CASEFLOW_WRITE", "")
        )

    def source_name(self, table: str) -> str:
        return f"{self.read}.{table}" if self.read else table

    def target_name(self, table: str) -> str:
        return f"{self.write}.{table}" if self.write else table

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.source_name(table))

    def target(self, table: str) -> DataFrame:
        return self.spark.table(self.target_name(table))


def parquet_tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in names]


def lookup(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A lookup sheet saved as CSV with a header; all columns are text unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def shared_view(rows: DataFrame, name: str) -> DataFrame:
    """Rows used by several queries: kept, and visible to SQL under a name."""
    kept = rows.persist()
    kept.createOrReplaceTempView(name)
    return kept
