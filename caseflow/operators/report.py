"""What reviewers and writers read: score tables, assessments, letters, contexts, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.text import (
    UNKNOWN,
    bold_runs,
    cut_template,
    or_default,
    paragraphs,
    without_leading_fence,
)
from caseflow.functions.values import any_of, clamp, fixed, number_text
from caseflow.operators.notes import NO_NOTES
from caseflow.operators.scores import ADMISSION, FIRST_DX
from caseflow.operators.textparts import PART_CHARS, by_part, text_parts
from caseflow.profiles import ORGAN_NAMES, SOFA_CRITERIA, Profile

# The least SOFA total that is reported, and the status notes of the tables. What a
# writer is told to do with a table is the profile's ``scoring_instructions``.
SOFA_GATE = 2
NO_SOFA = "SOFA score below 2 or unavailable."
NO_SCORES = "Clinical scores not available."
SOFA_NOTE_NO_DATA = (
    "Not included — insufficient structured data to calculate SOFA scores for this encounter."
)
PF_NOTE_NO_DATA = (
    "Not included — no valid PaO2/FiO2 pairs found in structured data for this encounter."
)


def window_label(mode: Column) -> Column:
    return (
        F.when(mode == ADMISSION, "POA-anchored to admission")
        .when(mode == FIRST_DX, "POA-anchored to first sepsis dx")
        .otherwise("best 24h window")
    )


def _lookup(table: dict, *keys: Column) -> Column:
    """A literal table as a map; one key per level of the table."""

    def literal(t):
        if not isinstance(t, dict):
            return F.lit(t)
        return F.create_map(*[x for k, v in t.items() for x in (F.lit(k), literal(v))])

    result = literal(table)
    for key in keys:
        result = F.try_element_at(result, key)
    return result


def organ_order(organ: Column) -> Column:
    return F.array_position(F.array(*[F.lit(o) for o in ORGAN_NAMES]), organ).cast("int")


def sofa_lines() -> Column:
    """Rows of the score table out of the organs array: those above 0, in report order."""
    shown = F.transform(
        F.filter("organs", lambda o: o["score"] > 0),
        lambda o: F.struct(
            organ_order(o["organ"]).alias("ord"),
            _lookup(ORGAN_NAMES, o["organ"]).alias("organ_name"),
            o["score"].alias("score"),
            o["value"].alias("value"),
            F.coalesce(_lookup(SOFA_CRITERIA, o["organ"], o["score"]), F.lit("")).alias(
                "criterion"
            ),
        ),
    )
    return F.array_sort(shown)


def sofa_text(scores: DataFrame) -> DataFrame:
    """The SOFA table of each account as Markdown; its wording is fixed."""
    rows = F.transform(
        sofa_lines(),
        lambda x: F.concat(
            F.lit("| "), x["organ_name"], F.lit(" | "), x["score"].cast("string"), F.lit(" | "),
            x["value"], F.lit(" | "), x["criterion"], F.lit(" |"),
        ),
    )
    total = F.concat(
        F.lit("| **TOTAL** | **"), F.col("total_score").cast("string"), F.lit("** | "),
        F.col("organs_scored").cast("string"), F.lit(" organs scored | |"),
    )
    window = F.concat(
        F.lit("24-hour scoring window ("), window_label(F.col("window_mode")), F.lit("): "),
        "window_start", F.lit(" to "), "window_end",
    )
    drugs = F.concat(F.lit("Vasopressors administered: "), "vasopressors")
    text = F.array_join(
        F.concat(
            F.array(F.lit("SOFA SCORES (calculated from raw clinical data):")),
            F.array_compact(F.array(window)),
            F.array(
                F.lit(""),
                F.lit("| Organ System | Score | Value | Criteria |"),
                F.lit("|---|---|---|---|"),
            ),
            rows,
            F.array(total, F.lit("")),
            F.array_compact(F.array(drugs)),
        ),
        "\n",
    )
    return scores.select(
        "account_id",
        F.when(F.coalesce(F.col("total_score") >= SOFA_GATE, F.lit(False)), text)
        .otherwise(NO_SOFA)
        .alias("scores_text"),
    )


def _shown_fraction(raw: Column, fraction: Column) -> Column:
    percent = F.concat(
        number_text(raw), F.lit("% ("), fixed(fraction, 2), F.lit(")")
    )
    share = F.concat(
        number_text(raw), F.lit(" ("), fixed(fraction * 100, 0), F.lit("%)")
    )
    return F.when(raw > 1.0, percent).otherwise(share)


def pf_cells(series: DataFrame) -> DataFrame:
    """The columns of the ratio table as text."""
    return series.select(
        "account_id",
        "position",
        "timestamp",
        number_text(F.col("pao2")).alias("pao2"),
        _shown_fraction(F.col("fio2_raw"), F.col("fio2_normalized")).alias("fio2"),
        F.coalesce(number_text(F.col("peep")), F.lit("N/A (no vent data)")).alias("peep"),
        number_text(F.col("ratio")).alias("ratio"),
        "classification",
    )


def pf_heading(summary: DataFrame, profile: Profile) -> DataFrame:
    """What stands above the ratio table, or in its place where no ratio qualifies."""
    n, worst = F.col("measurements_calculated").cast("string"), number_text(F.col("worst_ratio"))
    limit = F.lit(f"{profile.render_below:g}")
    shown = F.concat(
        F.lit("P/F RATIO MEASUREMENTS (calculated from raw ABG data — "), n,
        F.lit(" measurement(s), full encounter):\nWorst P/F ratio: "), worst, F.lit(" ("),
        "worst_classification", F.lit(") at "), "worst_timestamp",
    )
    hidden = F.concat(
        F.lit("P/F RATIO DATA: "), n, F.lit(" measurement(s) calculated. All ratios >= "), limit,
        F.lit(" (worst = "), worst, F.lit(")."),
    )
    return summary.select(
        "account_id",
        (F.col("n_qualifying") > 0).alias("qualifies"),
        F.when(F.col("n_qualifying") > 0, shown).otherwise(hidden).alias("heading"),
    )


# The head of the ratio table. The wording of the tables here (``sofa_text``, ``pf_cells``,
# ``pf_heading``) is fixed too.
PF_TABLE_HEAD = (
    "| Timestamp | PaO2 (mmHg) | FiO2 | PEEP (cmH2O) | P/F Ratio | Berlin Classification |\n"
    "|---|---|---|---|---|---|"
)


def pf_text(series: DataFrame, summary: DataFrame, profile: Profile, **options) -> DataFrame:
    """The ratio table as Markdown, in parts of bounded size: heading on the first, notes on the last."""
    line = F.concat(
        F.lit("| "),
        F.concat_ws(" | ", "timestamp", "pao2", "fio2", "peep", "ratio", "classification"),
        F.lit(" |"),
    )
    parts = text_parts(
        pf_cells(series), ["account_id"], line, "\n", F.col("position").cast("long"), (),
        width=10_000, **options,
    )
    heading = pf_heading(summary, profile)
    head = F.concat("heading", F.lit(f"\n\n{PF_TABLE_HEAD}\n"))
    last = F.col("part_no") == F.col("last_part")
    table = F.concat(
        F.when(F.col("part_no") == 0, head).otherwise(""),
        "text",
        F.when(last, F.lit(f"\n\n{profile.scoring_instructions}")).otherwise(""),
    )
    # the parts are computed once: the last one is told by the window that orders them
    later = Window.partitionBy("account_id").orderBy(F.col("part_no").desc())
    shown = (
        parts.withColumn("last_part", F.first("part_no").over(later))
        .join(heading.filter("qualifies"), "account_id")
        .select("account_id", "part_no", table.alias("scores_text"))
    )
    hidden = heading.filter("not qualifies").select(
        "account_id", F.lit(0).alias("part_no"), F.col("heading").alias("scores_text")
    )
    return shown.unionByName(hidden)


# --- report rows ------------------------------------------------------------------------------

REPORT = (
    "section string, ord int, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string, "
    "highlight boolean"
)


def _row(section: str, order: Column | int, *cells: Column | str, highlight: Column | bool = False):
    """One report row as a struct; cells that are not given are empty."""
    filled_cells = [*cells, *[""] * (6 - len(cells))]

    def column(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        F.lit(section).alias("section"),
        column(order).cast("int").alias("ord"),
        *[column(x).cast("string").alias(f"c{i + 1}") for i, x in enumerate(filled_cells)],
        column(highlight).alias("highlight"),
    )


def sofa_report(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows of the SOFA appendix, or the note that says why there is none."""
    joined = cases.select("account_id").join(scores, "account_id", "left")
    enough = F.coalesce(F.col("total_score") >= SOFA_GATE, F.lit(False))
    low = F.concat(
        F.lit("Not included — total SOFA score is "), F.col("total_score").cast("string"),
        F.lit(" (below threshold of 2). "), F.col("organs_scored").cast("string"),
        F.lit(" organ system(s) scored."),
    )
    note = F.when(F.col("total_score").isNull(), SOFA_NOTE_NO_DATA).otherwise(low)
    label = F.concat(F.lit("Scoring Window ("), window_label(F.col("window_mode")), F.lit("): "))
    span = F.concat("window_start", F.lit(" to "), "window_end")
    scored = F.concat(F.col("organs_scored").cast("string"), F.lit(" organs scored"))
    body = F.transform(
        sofa_lines(),
        lambda x: _row("organ", x["ord"], x["organ_name"], x["score"], x["value"], x["criterion"]),
    )
    table = F.concat(
        F.array(_row("window", 0, label, span)),
        body,
        F.array(_row("total", 99, "TOTAL", F.col("total_score"), scored, highlight=True)),
    )
    rows = F.when(enough, table).otherwise(F.array(_row("status_note", 0, "SOFA Table: ", note)))
    return joined.select("account_id", F.inline(rows))


def pf_report(
    cases: DataFrame, series: DataFrame, summary: DataFrame, profile: Profile
) -> DataFrame:
    """Rows of the ratio appendix; the worst measurement is highlighted."""
    limit = f"{profile.render_below:g}"
    all_cases = cases.select("account_id").join(summary, "account_id", "left")
    enough = F.coalesce(F.col("n_qualifying") > 0, F.lit(False))
    count, worst = F.col("measurements_calculated").cast("string"), F.col("worst_ratio")
    note = F.when(
        F.col("measurements_calculated").isNull(),
        F.lit(PF_NOTE_NO_DATA),
    ).otherwise(
        F.concat(
            F.lit("Not included — "), count,
            F.lit(f" measurement(s) calculated but all P/F ratios >= {limit} (worst = "),
            number_text(worst), F.lit(" at "), "worst_timestamp",
            F.lit("). No ARF-qualifying P/F values."),
        )
    )
    shown = all_cases.filter(enough)
    scope = F.concat(
        F.lit("Full encounter ("), count, F.lit(" ABG measurement(s)). Window: "),
        "window_start", F.lit(" to "), "window_end", F.lit("."),
    )
    head = F.when(enough, _row("window", 0, "Data Scope: ", scope)).otherwise(
        _row("status_note", 0, "P/F Ratio Table: ", note)
    )
    heads = all_cases.select("account_id", F.inline(F.array(head)))
    cells = pf_cells(series).join(
        shown.select("account_id", number_text(worst).alias("_worst")), "account_id"
    )
    names = ("timestamp", "pao2", "fio2", "peep", "ratio", "classification")
    body = _row(
        "measurement",
        F.col("position"),
        *[F.col(n) for n in names],
        highlight=F.col("ratio") == F.col("_worst"),
    )
    return heads.unionByName(cells.select("account_id", F.inline(F.array(body))))


# --- assessment -------------------------------------------------------------------------------

FINDINGS = "struct<score:string,findings:array<struct<status:string,item:string>>>"
ASSESSMENT = (
    "overall_score double, overall_rating string, summary string, "
    f"source_fidelity {FINDINGS}, criteria {FINDINGS}, argument_structure {FINDINGS}, "
    f"evidence_quality struct<clinical_notes:{FINDINGS},structured_data:{FINDINGS}>, "
    f"formatting_compliance {FINDINGS}"
)

# Marks of a finding's status.
STATUS_MARKS = {
    "present": "✓", "could_strengthen": "△", "missing": "✗",
    "correct": "✓", "incorrect": "✗",
    "compliant": "✓", "non_compliant": "✗",
}

# Dimensions in report order, and their titles.
DIMENSIONS = (
    ("source_fidelity", "SOURCE FIDELITY"),
    ("criteria", "CRITERIA"),
    ("argument_structure", "ARGUMENT STRUCTURE"),
    ("evidence_quality.clinical_notes", "EVIDENCE - Clinical Notes"),
    ("evidence_quality.structured_data", "EVIDENCE - Structured Data"),
    ("formatting_compliance", "FORMATTING COMPLIANCE"),
)


def parsed_assessment(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Assessment replies as structs; a reply that is no JSON gives null."""
    body = F.from_json(without_leading_fence(F.col(reply)), ASSESSMENT)
    rest = [c for c in replies.columns if c != reply]
    read = replies.select(*rest, body.alias("a"))
    ok = any_of([F.col(f"a.{f}").isNotNull() for f in ("overall_score", "summary", "criteria")])
    score = clamp(F.col("a.overall_score"), 1, 10)
    return read.select(
        *rest,
        F.when(F.col("a.overall_score").isNotNull(), score).alias("overall_score"),
        F.col("a.overall_rating").alias("overall_rating"),
        F.col("a.summary").alias("summary"),
        F.when(ok, F.col("a")).alias("assessment"),
    )


def assessment_rows(parsed: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """One row per finding: dimension, its score, status, mark and item."""
    dimension = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(title).alias("dimension"),
                F.col(f"assessment.{path}.score").alias("score"),
                F.col(f"assessment.{path}.findings").alias("findings"),
            )
            for i, (path, title) in enumerate(DIMENSIONS)
        ]
    )
    each = parsed.filter("assessment is not null").select(*keys, F.explode(dimension).alias("d"))
    finding = each.select(
        *keys, "d.ord", "d.dimension", "d.score", F.posexplode("d.findings").alias("item_no", "f")
    )
    return finding.select(
        *keys,
        "ord",
        "dimension",
        F.coalesce("score", F.lit("?")).alias("score"),
        "item_no",
        F.col("f.status").alias("status"),
        F.coalesce(_lookup(STATUS_MARKS, F.col("f.status")), F.lit("?")).alias("mark"),
        F.coalesce("f.item", F.lit("")).alias("item"),
    )


# --- letter -----------------------------------------------------------------------------------

EVIDENCE = "struct<criterion:string,value:string,threshold:string>"
LETTER = (
    "header struct<address:string,date:string>, payor_address string, appeal_level string, "
    "patient_info struct<beneficiary_name:string,dob:string,claim_reference:string,"
    "hospital_account:string,date_of_service:string>, salutation string, "
    "opening_paragraph string, justification string, "
    "rationale struct<payor_argument_quote:string,infection_source:string,"
    "organ_dysfunction:array<string>,sirs_criteria:array<string>,inflammatory_markers:array<string>,"
    "blood_culture:string,other_conditions:array<string>>, hospital_course string, "
    "summary_paragraph string, conclusion string, contact_info string, signature_block string"
)


def letter_text(letter: Column) -> Column:
    """A letter's JSON as plain text, section by section.

    The reply may hold the letter under ``letter``. Evidence is a list of texts, or of objects with
    criterion, value and threshold, or of both.
    """


    def parsed(wrapped: Column) -> Column:
        return F.from_json(F.when(wrapped.startswith("{"), wrapped).otherwise(letter), LETTER)

    # bound as arguments of functions: a column is parsed anew wherever it is mentioned
    read = F.transform(F.array(F.get_json_object(letter, "$.letter")), parsed)
    return F.element_at(F.transform(read, _letter_lines), 1)


def _letter_lines(a: Column) -> Column:
    """The text of a parsed letter."""

    def text(value: Column, default: str = "") -> Column:
        return F.coalesce(value, F.lit(default))

    def block(*lines: Column | str) -> Column:
        columns = [F.lit(line) if isinstance(line, str) else line for line in lines]
        return F.array(*columns)

    def optional(value: Column, *lines: Column | str) -> Column:
        none = F.array().cast("array<string>")
        present = F.coalesce(F.nullif(value, F.lit("")).isNotNull(), F.lit(False))
        return F.when(present, block(*lines)).otherwise(none)

    def listed(title: str, items: Column, line, read=lambda items: items) -> Column:
        none = F.array().cast("array<string>")
        body = F.concat(block(title), F.transform(read(items), line), block(""))
        return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, body).otherwise(none)

    def evidence_of(items: Column) -> Column:
        # an item read as text is the JSON of an object, or a plain text
        def pair(item: Column) -> Column:
            return F.struct(item.alias("text"), F.when(item.startswith("{"), F.from_json(item, EVIDENCE)).alias("parsed"))

        return F.transform(items, pair)

    def evidence(item: Column) -> Column:
        e = item["parsed"]
        stated = F.concat(
            text(e["criterion"]), F.lit(": "), text(e["value"]),
            F.lit(" (threshold: "), text(e["threshold"]), F.lit(")"),
        )
        return F.concat(F.lit("  - "), F.when(item["text"].startswith("{"), stated).otherwise(text(item["text"])))

    p, r = a["patient_info"], a["rationale"]
    labelled = (
        ("Beneficiary Name: ", "beneficiary_name"),
        ("DOB: ", "dob"),
        ("Claim reference #: ", "claim_reference"),
        ("Hospital Account #: ", "hospital_account"),
        ("Date of Service: ", "date_of_service"),
    )
    patient = [F.concat(F.lit(label), text(p[field])) for label, field in labelled]
    sections = [
        block(text(a["header"]["address"]), "", text(a["header"]["date"]), ""),
        block(text(a["payor_address"]), ""),
        block(text(a["appeal_level"], "First Level Appeal"), ""),
        block(*patient, ""),
        block(text(a["salutation"]), "", text(a["opening_paragraph"]), ""),
        block("Justification for Appeal:", "", text(a["justification"]), "", "Rationale:", ""),
        optional(r["payor_argument_quote"], r["payor_argument_quote"], ""),
        optional(
            r["infection_source"], F.concat(F.lit("Infection Source: "), r["infection_source"]), ""
        ),
        listed("Organ Dysfunction:", r["organ_dysfunction"], evidence, evidence_of),
        listed("SIRS Criteria Met:", r["sirs_criteria"], evidence, evidence_of),
        listed("Inflammatory Markers:", r["inflammatory_markers"], evidence, evidence_of),
        optional(r["blood_culture"], F.concat(F.lit("Blood Culture: "), r["blood_culture"]), ""),
        listed(
            "Other Conditions:", r["other_conditions"], lambda c: F.concat(F.lit("  - "), text(c))
        ),
        block("Hospital Course:", text(a["hospital_course"]), ""),
        block(text(a["summary_paragraph"]), "", "Conclusion:", "", text(a["conclusion"]), ""),
        block("Please direct all written correspondence to:", "", text(a["contact_info"]), ""),
        block("Sincerely,", "", text(a["signature_block"])),
    ]
    return F.array_join(F.concat(*sections), "\n")


def letter_runs(letters: DataFrame, keys: tuple[str, ...], text: str = "letter_text") -> DataFrame:
    """Paragraphs of a letter and their plain and bold runs, one row per run."""
    each = letters.select(
        *keys, F.posexplode(paragraphs(F.col(text))).alias("paragraph_no", "_paragraph")
    )
    return each.select(
        *keys, "paragraph_no", F.posexplode(bold_runs(F.col("_paragraph"))).alias("run_no", "_r")
    ).select(
        *keys, "paragraph_no", "run_no", F.col("_r.text").alias("text"), F.col("_r.bold").alias("bold")
    )


# --- writer context ---------------------------------------------------------------------------


# What stands between the parts of a text that comes in parts, where it is not the empty string.
PART_SEPARATORS = {
    "denial_text": "\n\n",
    "notes_section": "\n\n",
    "structured_summary": "\n\n",
    "rebuttals_section": "\n\n",
}


def rebuttal_sections(rebuttals: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rebuttals ``(account_id, name, text)`` as one section for each account, by name, in parts."""
    entry = F.concat(F.lit("## "), "name", F.lit("\n"), "text")
    parts = text_parts(rebuttals, ["account_id"], entry, "\n\n", F.lit(0).cast("long"), [F.col("name"), F.col("text")], part_chars)
    return parts.select("account_id", "part_no", F.col("text").alias("rebuttals_section"))


def writer_context(
    cases: DataFrame,
    template: str,
    profile: Profile,
    rebuttals: DataFrame | None = None,
    separators: dict[str, str] | None = None,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """The filled template per account in parts: ``(account_id, part_no, prompt)``, to be joined as they are.

    ``cases`` holds the columns named below, one row per account or, with a ``part_no``, per account and
    part of its texts; a missing text gets its default. ``rebuttals`` are those that apply to an account.

    The template is cut at its placeholders. Each stretch of it and each part of a text is a piece with a
    place, and pieces become parts by their running length; a text in parts is never one value.
    ``separators`` say what stands between the parts of a text (``PART_SEPARATORS``).
    """
    if "part_no" not in cases.columns:
        cases = cases.withColumn("part_no", F.lit(0))
    if rebuttals is None:
        cases = cases.withColumn("rebuttals_section", F.lit(None).cast("string"))
    else:
        cases = by_part(cases, (rebuttal_sections(rebuttals),), "account_id")
    first = F.col("part_no") == 0
    title = f"## OFFICIAL {profile.display_name.upper()} DEFINITION\n"

    def once(value: Column) -> Column:
        return F.when(first, value)

    def text(column: str, default: str = "", head: str = "") -> Column:
        own = F.col(column).cast("string")
        between = {**PART_SEPARATORS, **(separators or {})}.get(column, "")
        begun = F.coalesce(F.concat(F.lit(head), own), F.lit(default))
        later = F.concat(F.lit(between), F.nullif(own, F.lit("")))
        return F.when(first, begun).otherwise(later)

    values = {
        "denial_letter_text": text("denial_text"),
        "clinical_notes_section": text("notes_section", NO_NOTES),
        "structured_data_summary": text("structured_summary"),
        "clinical_scores_section": text("scores_text", NO_SCORES),
        "clinical_definition_section": text("definition", "No specific definition loaded.", title),
        "gold_letter_section": text("template_letter"),
        "scoring_instructions": once(F.lit(profile.scoring_instructions)),
        "conditional_rebuttals_section": text("rebuttals_section"),
        "patient_name": once(F.col("patient_name")),
        "hsp_account_id": once(F.col("account_id").cast("string")),
        "date_of_service": once(F.col("date_of_service")),
        "original_drg": once(or_default(F.col("original_drg"), UNKNOWN)),
        "proposed_drg": once(or_default(F.col("proposed_drg"), UNKNOWN)),
        "payor": once(or_default(F.col("payor"), UNKNOWN)),
    }
    pieces = [once(F.lit(piece)) if name is None else values[name] for piece, name in cut_template(template, set(values))]
    placed = cases.select(
        "account_id", "part_no", F.posexplode(F.array(F.lit(""), *pieces)).alias("place", "text")
    ).filter("text is not null")
    parts = text_parts(
        placed, ["account_id"], F.col("text"), "", F.col("place").cast("long"), [F.col("part_no")], part_chars, width=1
    )
    return parts.select("account_id", "part_no", F.col("text").alias("prompt"))


# --- status -----------------------------------------------------------------------------------


def case_status(
    parse_error: Column, in_scope: Column, generation_error: Column
) -> tuple[Column, Column]:
    """Status of a case and its reason; the first stage that stops it decides."""
    outside = ~F.coalesce(in_scope, F.lit(False))
    status = (
        F.when(parse_error.isNotNull(), "parse_error")
        .when(outside, "out_of_scope")
        .when(generation_error.isNotNull(), "generation_error")
        .otherwise("success")
    )
    reason = (
        F.when(parse_error.isNotNull(), parse_error)
        .when(outside, "Denial is not in scope")
        .when(generation_error.isNotNull(), generation_error)
    )
    return status, reason


def in_scope(is_condition_match: Column, scope: str) -> Column:
    """Whether a denial is worked on: all are, or those of the condition."""
    return F.lit(True) if scope == "all" else F.coalesce(is_condition_match, F.lit(False))


def drg_warning(original_drg: Column, codes: tuple[str, ...]) -> Column:
    odd = (original_drg != "") & ~original_drg.isin(*codes)
    return F.when(
        odd, F.concat(F.lit("original_drg '"), original_drg, F.lit("' not in expected codes"))
    )


def status_tally(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status").agg(F.count("*").alias("n_cases"))
