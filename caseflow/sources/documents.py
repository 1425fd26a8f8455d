"""Documents: file listings, new files, page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder tree as rows; contents are not read, as no one asks for the column."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "modificationTime",
            "length",
        )
    )


def new_files(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files not loaded before, by file name."""
    return files.join(loaded.select("file_name").distinct(), "file_name", "left_anti")


def text_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Text files, one row each: ``(doc_id, source_file, text)``; the id is a hash of the name."""
    rows = (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
    )
    return rows.select(F.sha2("source_file", 256).alias("doc_id"), "source_file", "text")
