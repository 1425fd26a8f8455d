"""One chronological timeline out of labs, vitals, medications, procedures and diagnoses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.times import micros
from caseflow.operators.textparts import text_parts
from caseflow.operators.windows import dedup_exact, top_per

ENCOUNTER = ("account_id", "encounter_id")
EVENT = (*ENCOUNTER, "event_ts", "event_type", "event_detail")

NO_TIMELINE = "No structured data available for this encounter."


def _events(rows: DataFrame, kind: str, detail: Column, abnormal: Column | None = None):
    return rows.select(
        *ENCOUNTER,
        "event_ts",
        F.lit(kind).alias("event_type"),
        detail.alias("event_detail"),
        (F.lit(0) if abnormal is None else abnormal).alias("is_abnormal"),
    )


def lab_events(labs: DataFrame) -> DataFrame:
    flag = F.col("abnormal_flag")
    flagged = F.when(flag.isNotNull(), F.concat(F.lit(" ("), flag, F.lit(")"))).otherwise("")
    units = F.coalesce("lab_units", F.lit(""))
    detail = F.concat("lab_name", F.lit(": "), "lab_value", F.lit(" "), units, flagged)
    return _events(labs, "LAB", detail, F.when(flag.isNotNull(), 1).otherwise(0))


def vital_events(vitals: DataFrame) -> DataFrame:
    return _events(vitals, "VITAL", F.concat("vital_name", F.lit(": "), "vital_value"))


def med_events(meds: DataFrame, unknown_route: str = "unknown") -> DataFrame:
    detail = F.concat(
        "med_name",
        F.lit(" "),
        F.coalesce("med_dose", F.lit("")),
        F.lit(" "),
        F.coalesce("med_units", F.lit("")),
        F.lit(" via "),
        F.coalesce("med_route", F.lit(unknown_route)),
        F.lit(" - "),
        "admin_action",
    )
    return _events(meds, "MEDICATION", detail)


def procedure_events(procedures: DataFrame) -> DataFrame:
    return _events(procedures, "PROCEDURE", F.col("procedure_name"))


def diagnosis_events(diagnoses: DataFrame) -> DataFrame:
    code, name = F.col("icd10_code"), F.col("dx_name")
    detail = F.concat(
        F.coalesce(code, F.lit("")),
        F.when(code.isNotNull() & name.isNotNull(), " - ").otherwise(""),
        F.coalesce(name, F.lit("Unknown diagnosis")),
    )
    return _events(diagnoses.filter(F.col("event_ts").isNotNull()), "DIAGNOSIS", detail)


def during_diagnosis_events(timed_diagnoses: DataFrame) -> DataFrame:
    """Coded diagnoses made during the encounter, with their source."""
    rows = timed_diagnoses.filter(
        (F.col("timing_category") == "DURING") & F.col("event_ts").isNotNull()
    )
    return _events(rows, "DIAGNOSIS", _sourced("icd10_code", " - "))


def _sourced(code: str, sep: str) -> Column:
    return F.concat(
        code,
        F.lit(sep),
        F.coalesce("icd10_description", F.lit("Unknown")),
        F.lit(" ("),
        "source",
        F.lit(")"),
    )


def merge_timeline(*streams: DataFrame) -> DataFrame:
    """Union of the event streams without exact duplicates.

    Of equal events the abnormal one is kept. The table is unordered: a report sorts what it reads.
    """
    return dedup_exact(reduce(DataFrame.unionByName, streams), EVENT, ["is_abnormal"])


def sectioned_timeline(
    encounters: DataFrame, timed_diagnoses: DataFrame, timeline: DataFrame
) -> DataFrame:
    """Encounter facts, pre-existing diagnoses and events, with the order of the sections."""
    pattern = "yyyy-MM-dd HH:mm:ss"
    facts = encounters.select(
        *ENCOUNTER,
        F.lit("ENCOUNTER_INFO").alias("section_type"),
        F.lit(0).alias("sort_order"),
        F.lit(None).cast("timestamp").alias("event_ts"),
        F.concat(
            F.lit("Account ID: "),
            F.col("account_id").cast("string"),
            F.lit("\nEncounter: "),
            F.col("encounter_id").cast("string"),
            F.lit("\nAdmission: "),
            F.date_format("start_ts", pattern),
            F.lit("\nDischarge: "),
            F.coalesce(F.date_format("end_ts", pattern), F.lit("Still admitted")),
        ).alias("content"),
    )
    earlier = (
        timed_diagnoses.filter(F.col("timing_category") == "BEFORE")
        .join(encounters.select("encounter_id").distinct(), "encounter_id", "left_semi")
        .select(
            *ENCOUNTER,
            F.lit("PRE_EXISTING_DX").alias("section_type"),
            F.lit(1).alias("sort_order"),
            F.col("event_ts").cast("timestamp").alias("event_ts"),
            _sourced("icd10_code", ": ").alias("content"),
        )
    )
    covered = (F.col("event_type") == "DIAGNOSIS") & F.col("event_detail").like("% - Pre-existing%")
    events = timeline.filter(~F.coalesce(covered, F.lit(False))).select(
        *ENCOUNTER,
        F.lit("TIMELINE_EVENT").alias("section_type"),
        F.lit(2).alias("sort_order"),
        F.col("event_ts").cast("timestamp").alias("event_ts"),
        F.concat(
            F.lit("["),
            F.date_format("event_ts", pattern),
            F.lit("] "),
            F.upper("event_type"),
            F.lit(": "),
            "event_detail",
        ).alias("content"),
    )
    return facts.unionByName(earlier).unionByName(events)


def sections_in_order(sectioned: DataFrame) -> DataFrame:
    """For a reader of few accounts: sections in order, rows without a time first."""
    return sectioned.orderBy(
        "account_id", "sort_order", F.col("event_ts").asc_nulls_first(), "content"
    )


def timeline_text(
    timeline: DataFrame,
    accounts: DataFrame | None = None,
    max_events: int | None = None,
    **parts,
) -> DataFrame:
    """Each account's events as lines ``[time] TYPE: detail (ABNORMAL)``, whole, in parts of bounded size.

    Gives ``(account_id, part_no, n_events, timeline_text)``. Accounts of ``accounts`` without events
    get the sentence that says so. ``max_events`` keeps an account's first events only, for readers
    that want no more; it is applied per task before the shuffle.
    """
    tie = [F.col("event_type"), F.col("event_detail"), F.col("encounter_id")]
    rows = timeline.withColumn("_us", micros(F.col("event_ts")))
    if max_events is not None:
        rows = top_per(rows, ["account_id"], [F.col("_us"), *tie], max_events)
        parts["few_rows"] = True
    line = F.concat(
        F.lit("["),
        F.coalesce(F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("None")),
        F.lit("] "),
        "event_type",
        F.lit(": "),
        F.coalesce("event_detail", F.lit("None")),
        F.when(F.col("is_abnormal") == 1, " (ABNORMAL)").otherwise(""),
    )
    text = text_parts(rows, ["account_id"], line, "\n", F.col("_us"), tie, **parts)
    text = text.withColumnsRenamed({"n_rows": "n_events", "text": "timeline_text"})
    if accounts is None:
        return text
    return (
        accounts.select("account_id")
        .distinct()
        .join(text, "account_id", "left")
        .select(
            "account_id",
            F.coalesce("part_no", F.lit(0)).alias("part_no"),
            F.coalesce("n_events", F.lit(0)).alias("n_events"),
            F.coalesce("timeline_text", F.lit(NO_TIMELINE)).alias("timeline_text"),
        )
    )
