"""Queries by name with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseflow.session import tune

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, each read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, rows)
        return rows


def query(name: str, sql: str | None = None):
    """Registers a function of the tables under a name, with its SQL if it has one."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(tune(spark), folder))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rounded(expression: str, digits: int) -> str:
    """Half-to-even rounding of a double's exact binary value."""
    return f"CAST(printf('%.{digits}f', {expression}) AS DOUBLE)"


def second(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"
