"""Clinical notes: lines to notes, notes to one text per account and type, gates and summaries."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import NO_ID, NO_NOTE, NOT_AVAILABLE, title_of
from caseflow.functions.times import DAY, micros
from caseflow.operators.slices import same_key
from caseflow.operators.textparts import PART_CHARS, text_parts
from caseflow.operators.windows import latest_per

# The note types read, each with the column stem of the wide table.
NOTE_TYPES = {
    "H&P": "hp_note",
    "Discharge Summary": "discharge_summary",
    "Progress Notes": "progress_note",
    "Consults": "consult_note",
    "ED Notes": "ed_notes",
    "Initial Assessments": "initial_assessment",
    "ED Triage Notes": "ed_triage",
    "ED Provider Notes": "ed_provider_note",
    "Addendum Note": "addendum_note",
    "Hospital Course": "hospital_course",
    "Subjective & Objective": "subjective_objective",
    "Assessment & Plan Note": "assessment_plan",
    "Nursing Note": "nursing_note",
    "Code Documentation": "code_documentation",
    "Anesthesia Preprocedure Evaluation": "anesthesia_preprocedure",
    "Anesthesia Postprocedure Evaluation": "anesthesia_postprocedure",
    "H&P (View-Only)": "hp_view_only",
    "Internal H&P Note": "internal_hp_note",
    "Anesthesia Procedure Notes": "anesthesia_procedure",
    "L&D Delivery Note": "ld_delivery_note",
    "Pre-Procedure Assessment": "pre_procedure_assessment",
    "Inpatient Medication Chart": "inpatient_med_chart",
    "Hospice": "hospice",
    "Hospice Plan of Care": "hospice_plan_of_care",
    "Hospice Non-Covered": "hospice_non_covered",
    "OR Post-Procedure Note": "or_post_procedure",
    "Peri-OP": "peri_op",
    "Treatment Plan": "treatment_plan",
    "Delivery": "delivery",
    "Brief Op Note": "brief_op_note",
    "Operative Report": "operative_report",
    "Scanned Form": "scanned_form",
    "Therapy Evaluation": "therapy_evaluation",
    "Therapy Treatment": "therapy_treatment",
    "Therapy Discharge": "therapy_discharge",
    "Therapy Progress Note": "therapy_progress_note",
    "Wound Care": "wound_care",
    "Anesthesia Post Evaluation": "anesthesia_post_eval",
    "Query": "query",
    "Anesthesia Post-Op Follow-up Note": "anesthesia_postop_followup",
    "Anesthesia Handoff": "anesthesia_handoff",
    "Anesthesia PAT Evaluation": "anesthesia_pat_eval",
    "Anesthesiology": "anesthesiology",
    "ED Attestation Note": "ed_attestation_note",
    "ED Procedure Note": "ed_procedure_note",
    "ED Re-evaluation Note": "ed_reeval_note",
    "CDU Provider Note": "cdu_provider_note",
}

# Notes in order of weight; all others follow.
NOTE_PRIORITY = {
    "discharge_summary": 1, "hp_note": 2, "progress_note": 3, "consult_note": 4,
    "ed_provider_note": 5, "query": 6, "ed_notes": 7, "nursing_note": 8,
}
OTHER_PRIORITY = 9

NOTE_SEPARATOR = "\n\n---\n\n"
NO_NOTES = "No clinical notes available."


def reassemble(
    lines: DataFrame,
    keys: list[str],
    text: str = "note_text",
    line: str = "line",
    sep: str = "\n",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Notes out of their numbered lines, ordered by line number."""
    return text_parts(
        lines, keys, F.col(text), sep, F.col(line).cast("long"), [F.col(text)], part_chars, 10_000
    ).withColumnRenamed("n_rows", "n_lines")


def notes_by_type(
    notes: DataFrame, part_chars: int = PART_CHARS, types: tuple[str, ...] = tuple(NOTE_TYPES)
) -> DataFrame:
    """All notes of an account and type as one text under time headers, with their ids.

    Input ``(account_id, note_type, note_id, note_csn_id, contact_date, entry_ts, note_text)``;
    notes run in order of contact date and entry time. A note without text adds its ids only. Notes
    may come in parts, with a ``part_no``.
    """
    wanted = notes.filter(F.col("note_type").isin(*types))
    at = F.coalesce(F.col("entry_ts"), F.col("contact_date").cast("timestamp"))
    header = F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("Unknown time"))
    headed = F.concat(F.lit("["), header, F.lit("]\n"), "note_text")
    note_id, csn = F.col("note_id").cast("string"), F.col("note_csn_id").cast("string")
    tie = [F.col("entry_ts"), F.col("note_id")]
    if "part_no" in notes.columns:
        # a note is headed and named once; its further parts follow it
        opens = F.col("part_no") == 0
        headed = F.when(opens, headed).otherwise(F.col("note_text"))
        note_id, csn = F.when(opens, note_id), F.when(opens, csn)
        tie.append(F.col("part_no"))
    body = F.when(F.length("note_text") > 0, headed)
    day = micros(F.col("contact_date").cast("timestamp"))
    parts = text_parts(
        wanted,
        ["account_id", "note_type"],
        body,
        NOTE_SEPARATOR,
        day,
        tie,
        part_chars,
        DAY,
        collect={"_ids": note_id, "_csns": csn},
    )

    def listed(c: str) -> Column:
        return F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(NO_ID))

    return parts.select(
        "account_id",
        "note_type",
        "part_no",
        F.col("n_rows").alias("n_notes"),
        listed("_ids").alias("note_ids"),
        listed("_csns").alias("note_csn_ids"),
        F.coalesce(F.nullif("text", F.lit("")), F.lit(NO_NOTE)).alias("note_text"),
    )


def wide_part_chars(types: Collection[str] = NOTE_TYPES) -> int:
    return PART_CHARS // max(1, len(types))


def notes_wide(by_type: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """One row per account and part with three columns per note type; gaps hold the sentinels.

    The pivot names its values, so Spark needs no pass over the data to find them. All types stand side by
    side: given notes in parts of ``wide_part_chars``, a row has no more text than a part elsewhere.
    """
    types = NOTE_TYPES if types is None else types
    pivoted = (
        by_type.groupBy("account_id", "part_no")
        .pivot("note_type", list(types))
        .agg(
            F.first("note_ids").alias("id"),
            F.first("note_csn_ids").alias("csn_id"),
            F.first("note_text").alias("text"),
        )
    )
    columns = [F.col("account_id"), F.col("part_no")]
    for note_type, stem in types.items():
        for suffix, default in (("id", NO_ID), ("csn_id", NO_ID), ("text", NO_NOTE)):
            columns.append(
                F.coalesce(F.col(f"`{note_type}_{suffix}`"), F.lit(default)).alias(
                    f"{stem}_{suffix}"
                )
            )
    return pivoted.select(*columns)


def latest_notes(notes: DataFrame) -> DataFrame:
    """The latest note per account and type; of a note in parts, all its parts."""
    if "part_no" in notes.columns:
        first = latest_notes(notes.drop("part_no", "note_text").distinct())
        return same_key(notes, first.select("account_id", "note_type", "note_id"), ("account_id", "note_type", "note_id"), "left_semi")
    order = [
        F.col("contact_date").desc(),
        F.col("entry_ts").desc(),
        F.col("note_id").desc(),
    ]
    return latest_per(notes, ["account_id", "note_type"], order)


def notes_per_type(notes: DataFrame) -> DataFrame:
    return notes.groupBy("account_id", "note_type").agg(F.count("*").alias("n_notes"))


def gate(text: Column, extraction: Column | None = None) -> Column:
    """What stands for a note: its extraction, else the whole note, else a mark of absence."""
    missing = text.isNull() | (text == NO_NOTE) | (text == "")
    whole = text if extraction is None else F.coalesce(F.nullif(extraction, F.lit("")), text)
    return F.when(missing, NOT_AVAILABLE).otherwise(whole)


def priority(note_key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NOTE_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, note_key), F.lit(OTHER_PRIORITY))


def available(text: Column) -> Column:
    return F.length(text).isNotNull() & (text != "") & (text != NOT_AVAILABLE)


def notes_summary(extracted: DataFrame, chars: int | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """``## key`` and each available note, in key order: ``(account_id, part_no, notes_summary)``.

    Notes are whole; ``chars`` keeps the start of each only.
    """
    rows = extracted.filter(available(F.col("note_text")))
    text = F.col("note_text") if chars is None else F.left("note_text", F.lit(chars))
    entry = F.concat(F.lit("## "), "note_key", F.lit("\n"), text)
    keys = [F.col("note_key"), *([F.col("part_no")] if "part_no" in extracted.columns else [])]
    parts = text_parts(rows, ["account_id"], entry, "\n\n", F.lit(0).cast("long"), keys, part_chars)
    return parts.select("account_id", "part_no", F.col("text").alias("notes_summary"))


def notes_section(extracted: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The notes for a writer, by priority, then key, under titled headings.

    Gives ``(account_id, part_no, n_notes, notes_section)``; a part holds so much text that no task
    gathers more, and an account's parts joined by a blank line are its whole section.
    """
    shown = available(F.col("note_text"))
    entry = F.when(
        shown, F.concat(F.lit("## "), title_of(F.col("note_key")), F.lit("\n"), "note_text")
    )
    keys = [F.col("note_key"), *([F.col("part_no")] if "part_no" in extracted.columns else [])]
    place = priority(F.col("note_key")).cast("long")
    parts = text_parts(extracted, ["account_id"], entry, "\n\n", place, keys, part_chars, width=1)
    # after the last text a part may hold missing notes only
    return parts.filter("part_no = 0 or n_rows > 0").select(
        "account_id",
        "part_no",
        F.col("n_rows").alias("n_notes"),
        F.coalesce(F.nullif("text", F.lit("")), F.lit(NO_NOTES)).alias("notes_section"),
    )
