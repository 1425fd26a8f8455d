"""Case tables read back by account, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import UNKNOWN
from caseflow.operators.textparts import by_part

NO_SUMMARY = "No structured data available."


def read_back(
    denial: DataFrame,
    clinical: DataFrame,
    summary: DataFrame,
    scores: DataFrame,
    conflicts: DataFrame,
    facility: str = "",
) -> DataFrame:
    """The five case tables of all accounts, one row per account and ``part_no``; gaps hold the documented defaults.

    A table of text in parts (it has a ``part_no``) has each part on the row of that number; the values of
    the others stand on every row of the account. Without long texts an account has the one row of part 0.
    A text that has ended is empty on the rows after, where it would otherwise have a default.
    ``conflicts`` has an array, or null, and a recommendation.
    """
    joined = by_part(denial, (clinical, summary, scores, conflicts), "account_id")
    # what is missing on a further part is so because the text has ended
    no_summary = F.when(F.col("part_no") > 0, "").otherwise(NO_SUMMARY)
    empty = F.array().cast("array<string>")
    return joined.select(
        "account_id",
        "part_no",
        "denial_text",
        F.coalesce("payor", F.lit(UNKNOWN)).alias("payor"),
        "original_drg",
        "proposed_drg",
        F.coalesce("is_condition_match", F.lit(False)).alias("is_condition_match"),
        F.coalesce("patient_name", F.lit(UNKNOWN)).alias("patient_name"),
        F.coalesce("patient_dob", F.lit("")).alias("patient_dob"),
        F.coalesce("facility_name", F.lit(facility)).alias("facility_name"),
        F.coalesce("date_of_service", F.lit("")).alias("date_of_service"),
        F.coalesce("structured_summary", no_summary).alias("structured_summary"),
        "total_score",
        "organs_scored",
        F.coalesce("conflicts", empty).alias("conflicts"),
        F.coalesce("recommendation", F.lit("")).alias("recommendation"),
    )


def case_summary(cases: DataFrame, note_counts: DataFrame) -> DataFrame:
    """Per account what a run produced: notes, summary length, score, conflicts, over all parts of ``read_back``."""
    first = {c: F.min_by(c, "part_no").alias(c) for c in ("patient_name", "total_score", "organs_scored")}
    whole = cases.groupBy("account_id").agg(
        *first.values(),
        F.sum(F.length("structured_summary")).alias("summary_chars"),
        F.sum(F.size("conflicts")).cast("int").alias("n_conflicts"),
    )
    return whole.join(note_counts, "account_id", "left").select(
        "account_id",
        "patient_name",
        F.coalesce("n_notes", F.lit(0)).cast("long").alias("n_notes"),
        F.coalesce("summary_chars", F.lit(0)).alias("summary_chars"),
        F.coalesce("total_score", F.lit(0)).alias("total_score"),
        F.coalesce("organs_scored", F.lit(0)).alias("organs_scored"),
        "n_conflicts",
    )
