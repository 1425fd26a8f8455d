"""A feature row per account: the spine keeps every account, whatever is known of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.textparts import by_part
from caseflow.operators.windows import top_per


def latest_encounters(encounters: DataFrame) -> DataFrame:
    """The encounter of latest admission per account."""
    order = [F.col("admit_ts").desc(), F.col("encounter_id").desc()]
    return top_per(encounters.filter("admit_ts is not null"), ["account_id"], order, 1)


def first_claims(claims: DataFrame, order: str, columns: tuple[str, ...]) -> DataFrame:
    """One claim's values per account: those of the first claim in order."""
    return claims.groupBy("account_id").agg(*[F.min_by(c, order).alias(c) for c in columns])


def spine_features(spine: DataFrame, *features: DataFrame) -> DataFrame:
    """Left joins of tables to the distinct accounts of the spine: one row per account and ``part_no``.

    A table of text in parts (it has a ``part_no``) has each part on the row of that number; the values of
    the others stand on every row of the account. Without long texts an account has the one row of part 0.
    """
    return by_part(spine.select("account_id").distinct(), features, "account_id")
