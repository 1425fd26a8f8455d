"""Schemas of the tables that are written, as DDL. Nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

ENCOUNTERS = (
    "account_id BIGINT, encounter_id BIGINT, patient_id BIGINT, start_ts TIMESTAMP, end_ts TIMESTAMP"
)
LABS = (
    "account_id BIGINT, encounter_id BIGINT, event_ts TIMESTAMP, lab_name STRING, "
    "lab_value STRING, lab_units STRING, abnormal_flag STRING"
)
VITALS = (
    "account_id BIGINT, encounter_id BIGINT, event_ts TIMESTAMP, vital_name STRING, "
    "vital_value STRING"
)
MEDS = (
    "account_id BIGINT, encounter_id BIGINT, event_ts TIMESTAMP, med_name STRING, "
    "med_dose STRING, med_units STRING, med_route STRING, admin_action STRING"
)
DIAGNOSES = (
    "account_id BIGINT, encounter_id BIGINT, dx_id BIGINT, dx_name STRING, icd10_code STRING, "
    "event_ts TIMESTAMP, source STRING, poa_code INT"
)
TIMELINE = (
    "account_id BIGINT, encounter_id BIGINT, event_ts TIMESTAMP, event_type STRING, "
    "event_detail STRING, is_abnormal INT"
)
CLAIMS = (
    "account_id BIGINT, parameter STRING, value STRING, unit STRING, timestamp STRING"
)
LETTERS = (
    "letter_id STRING NOT NULL, condition_name STRING, source_file STRING, payor STRING, "
    "part_no INT, rebuttal_text STRING, denial_text STRING, embedding ARRAY<FLOAT>, "
    "metadata MAP<STRING, STRING>, created_at TIMESTAMP"
)
DEFINITIONS = (
    "condition_name STRING, source_file STRING, definition_text STRING, "
    "definition_summary STRING, created_at TIMESTAMP"
)
CASE_DENIAL = (
    "account_id BIGINT, denial_text STRING, denial_embedding ARRAY<FLOAT>, payor STRING, "
    "original_drg STRING, proposed_drg STRING, is_condition_match BOOLEAN, "
    "condition_name STRING, created_at TIMESTAMP"
)
CASE_CLINICAL = (
    "account_id BIGINT, patient_name STRING, patient_dob STRING, facility_name STRING, "
    "date_of_service STRING, extracted_notes STRING, created_at TIMESTAMP"
)
CASE_SUMMARY = ("account_id BIGINT, structured_summary STRING, created_at TIMESTAMP")
CASE_CONFLICTS = (
    "account_id BIGINT, conflicts STRING, recommendation STRING, created_at TIMESTAMP"
)
SOFA_SCORES = (
    "account_id BIGINT, total_score INT, organs_scored INT, organ_scores STRING, "
    "vasopressors STRING, window_start STRING, window_end STRING, window_mode STRING, "
    "created_at TIMESTAMP"
)
PF_MEASUREMENTS = (
    "account_id BIGINT, position INT, us BIGINT, timestamp STRING, pao2 DOUBLE, "
    "fio2_raw DOUBLE, fio2_normalized DOUBLE, peep DOUBLE, ratio DOUBLE, classification STRING"
)


def records(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few rows made by hand, with their schema stated."""
    return spark.createDataFrame(list(rows), schema)
