"""Sinks: tables created once, overwritten, appended, or replaced by slice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caseflow.operators.slices import same_key
from caseflow.session import checkpoint_dir


def create_if_missing(
    spark: SparkSession, name: str, schema: str, partition_by: tuple[str, ...] = ()
) -> bool:
    """An empty table of the schema, unless one exists. Tells whether it was created."""
    if spark.catalog.tableExists(name):
        return False
    spark.createDataFrame([], schema).write.partitionBy(*partition_by).format(
        "parquet"
    ).saveAsTable(name)
    return True


def create_from(rows: DataFrame, name: str) -> bool:
    """A table out of a query, unless one exists; the query is not run if it does."""
    if rows.sparkSession.catalog.tableExists(name):
        return False
    rows.write.format("parquet").saveAsTable(name)
    return True


def overwrite(rows: DataFrame, name: str) -> None:
    """Replaces the table with the rows. ``rows`` must not read the table itself."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").format(
        "parquet"
    ).saveAsTable(name)


def append(rows: DataFrame, name: str) -> None:
    """Adds rows; columns are matched by name, columns the rows lack are null."""
    table = rows.sparkSession.table(name)
    shaped = table.limit(0).unionByName(rows, allowMissingColumns=True)
    shaped.select(*table.columns).write.mode("append").format("parquet").saveAsTable(name)


def append_widening(rows: DataFrame, path: str) -> None:
    """Adds rows that may have new columns; ``read_widened`` shows the union of columns."""
    rows.write.mode("append").parquet(path)


def read_widened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def replace_slice(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the partitions of the key values that occur in the rows and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        key
    ).parquet(path)


def write_bucketed(rows: DataFrame, name: str, key: str = "account_id", buckets: int = 64) -> None:
    """A table in buckets of a key, for tables that are joined by it again and again.

    Tables of the same key and number of buckets are joined without a shuffle (``plans.case.read_back``).
    """
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)


BUCKET = "_bucket"


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_keyed(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A table whose rows can be replaced by key: partitioned by a hash of the key, a file for each bucket.

    For results of a few rows per key; the more rows, the more ``buckets``.
    """
    _bucketed(rows, key, buckets).repartition(BUCKET).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy(BUCKET).parquet(path)


def replace_keys(rows: DataFrame, keys: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """In a table of ``write_keyed`` the rows of all ``keys`` make way for ``rows``; all others stay.

    Only buckets that hold one of the keys are written. A key may have no rows any more. The new contents
    are staged before they replace the old; on plain Parquet the replacement is not atomic, and a run that
    is repeated gives the same table.
    """
    spark = rows.sparkSession
    keys = staged(_bucketed(keys.select(key).distinct(), key, buckets))
    touched = {r[0] for r in keys.select(BUCKET).distinct().collect()}  # at most ``buckets``
    stored = spark.read.schema(StructType([*rows.schema.fields, StructField(BUCKET, IntegerType())])).parquet(path)
    kept = stored.filter(F.col(BUCKET).isin(*touched)).join(keys.select(key), key, "left_anti").select(*rows.columns, BUCKET)
    fresh = staged(kept.unionByName(_bucketed(rows, key, buckets)))
    filled = {r[0] for r in fresh.select(BUCKET).distinct().collect()}
    replace_slice(fresh.repartition(BUCKET), path, BUCKET)
    for bucket in touched - filled:
        _delete(spark, f"{path}/{BUCKET}={bucket}")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unseen(rows: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose keys the table does not hold; running the same insert again adds nothing."""
    return same_key(rows, table.select(*keys).distinct(), keys, "left_anti")


def first_of_each(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key: the smallest by the other columns, so the choice does not depend on the layout."""
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")) if rest else rows.distinct()
    return least.select(*[f"_r.{c}" if c in rest else c for c in rows.columns])


def insert_unseen(rows: DataFrame, name: str, keys: tuple[str, ...]) -> None:
    """Appends one row for each key that the table does not hold."""
    append(unseen(first_of_each(rows, keys), rows.sparkSession.table(name), keys), name)


def insert_unseen_files(rows: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """As ``insert_unseen``, for a table that is a folder of Parquet files."""
    table = rows.sparkSession.read.parquet(path)
    fresh = unseen(first_of_each(rows, keys), table, keys)
    # the rows are staged first: a folder cannot be read and appended to in one job
    staged(fresh).write.mode("append").parquet(path)


def stamped(rows: DataFrame, column: str = "insert_tsp") -> DataFrame:
    return rows.withColumn(column, F.current_timestamp())


def staged(rows: DataFrame) -> DataFrame:
    """The rows written to the cluster's shared checkpoint folder and read back.

    For a table several later steps read: it is computed once, its lineage ends here, and the loss
    of an executor costs a re-read. Parquet, so later steps read the columns they need. The folder is the
    one ``spark.checkpoint.dir`` names; only a local session without that setting gets one of this machine.
    """
    spark = rows.sparkSession
    path = f"{_staging_folder(spark)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _staging_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def remove_staged(spark: SparkSession) -> None:
    """Deletes what this application staged; for the end of a run, when no frame reads it any more."""
    _delete(spark, _staging_folder(spark))


def write_texts(rows: DataFrame, path: str, key: str, text: str) -> None:
    """One folder of text per key value, for letters to hand out."""
    rows.select(key, text).write.mode("overwrite").partitionBy(key).text(path)
