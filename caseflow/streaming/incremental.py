"""What is new since the last run, and files taken in once each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from caseflow.plans.workqueue import high_water_mark
from caseflow.session import checkpoint_dir
from caseflow.sources.sinks import insert_unseen, replace_keys, staged


def to_score(
    source: DataFrame, scored: DataFrame, default: Column, key: str = "account_id",
    ts: str = "insert_tsp",
) -> DataFrame:
    """Source rows newer than the latest scored one, and rows of keys that were never scored."""
    mark = high_water_mark(scored, ts, default)
    known = scored.select(key).filter(F.col(key).isNotNull()).distinct()
    joined = source.join(known.withColumn("_known", F.lit(True)), key, "left")
    return joined.filter((F.col(ts) > mark) | F.col("_known").isNull()).drop("_known")


def touched(tables: dict[str, DataFrame], since: Column, key: str = "account_id", ts: str = "event_ts") -> DataFrame:
    """Keys with a row since the mark in any of the tables, each once."""
    news = [t.filter(F.col(ts) > since).select(key) for t in tables.values()]
    return reduce(DataFrame.unionByName, news).filter(F.col(key).isNotNull()).distinct()


def refresh(
    path: str,
    keys: DataFrame,
    tables: dict[str, DataFrame],
    compute: Callable[[dict[str, DataFrame]], DataFrame],
    key: str = "account_id",
    buckets: int = 64,
) -> None:
    """Brings a stored result up to date for the keys that changed.

    ``compute`` makes the result, whose rows each belong to one key and depend on that key's rows only,
    out of ``tables``. It gets the tables cut to the ``keys``, and only their rows of the result (a table
    of ``sinks.write_keyed``) are replaced. So the cost follows what the changed keys own, and the
    result is that of a full run.
    """
    keys = staged(keys.select(key).distinct())
    own = {name: t.join(keys, key, "left_semi") for name, t in tables.items()}
    replace_keys(compute(own), keys, path, key, buckets)


def unprocessed_letters(letters: DataFrame, processed: DataFrame, min_chars: int = 100):
    """Letters that were not processed yet; ``skip_reason`` says why one has no usable text, else null."""
    chars = F.coalesce(F.length("letter_text"), F.lit(0))
    reason = F.concat(F.lit("Insufficient text ("), chars.cast("string"), F.lit(" chars)"))
    left = letters.join(processed.select("letter_id").distinct(), "letter_id", "left_anti")
    return left.withColumn("skip_reason", F.when(chars <= min_chars, reason))


def ingest_available(
    spark: SparkSession,
    folder: str,
    schema: str,
    table: str,
    keys: tuple[str, ...],
    name: str,
) -> StreamingQuery:
    """Takes in the Parquet files that are there and not taken in yet, then stops.

    The stream's checkpoint remembers the files, and each batch inserts unseen keys only, so a batch
    that is run again after a failure adds nothing twice.
    """

    def insert(batch: DataFrame, _: int) -> None:
        insert_unseen(batch, table, keys)

    return (
        spark.readStream.schema(schema)
        .parquet(folder)
        .writeStream.foreachBatch(insert)
        .option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}")
        .trigger(availableNow=True)
        .start()
    )
