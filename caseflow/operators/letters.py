"""Letters: pages, the split of rebuttal and denial, replies about them, duplicates, scan quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import UNKNOWN, condition_of_file, key_values, opening, or_default, squeeze
from caseflow.functions.values import account_number, any_of, fixed
from caseflow.operators.textparts import PART_CHARS, text_parts
from caseflow.profiles import Profile
from caseflow.sources.sinks import staged

# What a payor is recognised by, in the order of trial, and its name.
PAYORS = (
    ("unitedhealth", "UnitedHealthcare"),
    ("united health", "UnitedHealthcare"),
    ("uhc", "UnitedHealthcare"),
    ("optum", "UnitedHealthcare"),
    ("aetna", "Aetna"),
    ("cigna", "Cigna"),
    ("evernorth", "Cigna"),
    ("humana", "Humana"),
    ("anthem", "Anthem"),
    ("elevance", "Anthem"),
    ("blue cross", "Blue Cross Blue Shield"),
    ("blue shield", "Blue Cross Blue Shield"),
    ("bcbs", "Blue Cross Blue Shield"),
    ("wellpoint", "Anthem"),
    ("kaiser", "Kaiser Permanente"),
    ("molina", "Molina Healthcare"),
    ("centene", "Centene"),
    ("ambetter", "Centene"),
    ("wellcare", "Centene"),
    ("healthnet", "Health Net"),
    ("medicaid", "Medicaid"),
    ("medicare", "Medicare"),
    ("essence", "Essence Healthcare"),
)

# Subject lines of a denial that names no payor.
SUBJECT_PHRASES = (
    "claim review determination",
    "medical necessity review",
    "utilization review",
    "peer review determination",
    "clinical review",
    "prior authorization",
    "re: claim",
    "re: member",
    "re: patient",
)

def pages_of(documents: DataFrame, lines_per_page: int, text: str = "text") -> DataFrame:
    """Documents cut into pages of so many lines: ``(…, page_no, page_text)``, numbered from 1."""
    lines = F.split(F.col(text), "\n")

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(whole), F.lit(lines_per_page))
        return F.transform(starts, lambda s: F.array_join(F.slice(whole, s, lines_per_page), "\n"))

    # the lines are bound to a variable: named inside a lambda, the split would run for every page
    pages = F.element_at(F.transform(F.array(lines), cut), 1)
    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, F.posexplode(pages).alias("page_no", "page_text")).withColumn(
        "page_no", F.col("page_no") + 1
    )


def joined_pages(pages: DataFrame, keys: Sequence[str] = ("doc_id",), part_chars: int = PART_CHARS):
    """Pages of a document as one text, a blank line between them."""
    return text_parts(
        pages, keys, F.col("page_text"), "\n\n", F.col("page_no").cast("long"), (), part_chars, 1000
    )


def denial_start(
    pages: DataFrame,
    payors: Sequence[tuple[str, str]] = PAYORS,
    phrases: Sequence[str] = SUBJECT_PHRASES,
    header_lines: int | None = None,
) -> DataFrame:
    """Per document the page its denial starts on and the payor named there.

    Page 1 is always rebuttal. The first later page that names a payor starts the denial; without one,
    the first that holds a subject phrase; without that, all is rebuttal. Whole pages are read, or of
    each page the first ``header_lines`` lines if the caller says so.
    """
    header = F.lower("page_text")
    if header_lines is not None:
        header = F.substring_index(header, "\n", header_lines)
    payor = F.when(F.lit(False), "")
    for pattern, name in payors:
        payor = payor.when(header.contains(pattern), name)
    seen = pages.select(
        "doc_id",
        "page_no",
        F.when(F.col("page_no") > 1, payor).alias("payor"),
        ((F.col("page_no") > 1) & any_of([header.contains(p) for p in phrases])).alias("subject"),
    )
    found = seen.groupBy("doc_id").agg(
        F.max("page_no").alias("total_pages"),
        F.min(F.when(F.col("payor").isNotNull(), F.col("page_no"))).alias("payor_page"),
        F.min_by("payor", F.when(F.col("payor").isNotNull(), F.col("page_no"))).alias("payor"),
        F.min(F.when(F.col("subject"), F.col("page_no"))).alias("subject_page"),
    )
    return found.select(
        "doc_id",
        "total_pages",
        F.coalesce("payor_page", "subject_page", F.col("total_pages") + 1).alias(
            "denial_start_page"
        ),
        F.coalesce("payor", F.lit(UNKNOWN)).alias("payor"),
    )


def letter_sections(
    pages: DataFrame, starts: DataFrame, part_chars: int = PART_CHARS
) -> DataFrame:
    """Rebuttal and denial text of each document: ``(doc_id, section, part_no, n_rows, text)``."""
    placed = pages.join(starts.select("doc_id", "denial_start_page"), "doc_id").withColumn(
        "section",
        F.when(F.col("page_no") < F.col("denial_start_page"), "rebuttal").otherwise("denial"),
    )
    return joined_pages(placed, ["doc_id", "section"], part_chars)


def letter_library(
    files: DataFrame, pages: DataFrame, condition: Column, as_of: Column, **split
) -> DataFrame:
    """Past letters by condition, one row per file and text part.

    ``files``: ``(doc_id, source_file, embedding)``. The letter id is a hash of the file name.
    """
    starts = denial_start(pages, **split)
    sections = (
        letter_sections(pages, starts)
        .groupBy("doc_id", "part_no")
        .pivot("section", ["rebuttal", "denial"])
        .agg(F.first("text"))
    )
    metadata = F.create_map(
        F.lit("denial_start_page"), F.col("denial_start_page").cast("string"),
        F.lit("total_pages"), F.col("total_pages").cast("string"),
    )
    return (
        files.join(starts, "doc_id")
        .join(sections, "doc_id")
        .select(
            F.sha2("source_file", 256).alias("letter_id"),
            condition.alias("condition_name"),
            "source_file",
            "payor",
            "part_no",
            F.coalesce("rebuttal", F.lit("")).alias("rebuttal_text"),
            F.coalesce("denial", F.lit("")).alias("denial_text"),
            "embedding",
            metadata.alias("metadata"),
            as_of.alias("created_at"),
        )
    )


def definition_library(files: DataFrame, as_of: Column, prefix: str = "") -> DataFrame:
    """Condition definitions; the full text stands in for a summary that is missing or empty."""
    summary = F.coalesce(F.nullif("definition_summary", F.lit("")), F.col("definition_text"))
    return files.select(
        condition_of_file(F.col("source_file"), prefix).alias("condition_name"),
        "source_file",
        "definition_text",
        summary.alias("definition_summary"),
        as_of.alias("created_at"),
    )


def denial_fields(replies: DataFrame, profile: Profile, reply: str = "reply") -> DataFrame:
    """Typed denial fields out of a ``KEY: value`` reply."""
    # a later NONE does not take back what was stated
    parsed = replies.withColumn(
        "_kv", key_values(F.col(reply), ("ACCOUNT_ID", "ORIGINAL_DRG", "PROPOSED_DRG"))
    )

    def got(key: str) -> Column:
        return F.try_element_at("_kv", F.lit(key))

    return parsed.select(
        *[c for c in replies.columns if c != reply],
        account_number(got("ACCOUNT_ID")).alias("hsp_account_id"),
        or_default(got("PAYOR"), UNKNOWN).alias("payor"),
        got("ORIGINAL_DRG").alias("original_drg"),
        got("PROPOSED_DRG").alias("proposed_drg"),
        F.coalesce(F.upper(got(profile.denial_field.upper())) == "YES", F.lit(False)).alias(
            "is_condition_match"
        ),
    )


# Words in a denial reason, DRG codes, and the condition they point to, in order.
SEPSIS_DRGS = ("870", "871", "872")
PNEUMONIA_DRGS = ("177", "178", "179", "193", "194", "195")
CARDIAC_DRGS = ("280", "281", "282", "283", "284", "285")
REASON_WORDS = (
    ("sepsis", ("sepsis", "septic")),
    ("pneumonia", ("pneumonia",)),
    ("cardiac", ("cardiac", "heart", "mi")),
)


def condition_type(
    is_sepsis: Column, original_drg: Column, proposed_drg: Column, reasons: Column,
    whole_word: bool = False,
) -> Column:
    """Condition of a denial by flag, DRG codes, then the first reason text that names one.

    ``reasons`` is an array of texts in order. "mi" is matched inside words unless ``whole_word``.
    """

    def named(reason: Column) -> Column:
        lowered = F.lower(reason)
        result = F.when(F.lit(False), "")
        for condition, words in REASON_WORDS:
            hits = [
                lowered.rlike(rf"\b{w}\b") if whole_word else lowered.contains(w) for w in words
            ]
            result = result.when(any_of(hits), condition)
        return result

    first = F.try_element_at(F.array_compact(F.transform(reasons, named)), F.lit(1))
    sepsis_drg = original_drg.isin(*SEPSIS_DRGS) | proposed_drg.isin(*SEPSIS_DRGS)
    return (
        F.when(is_sepsis, "sepsis")
        .when(sepsis_drg, "sepsis")
        .when(original_drg.isin(*PNEUMONIA_DRGS), "pneumonia")
        .when(original_drg.isin(*CARDIAC_DRGS), "cardiac")
        .otherwise(F.coalesce(first, F.lit("default")))
    )


# What counts as evidence for a condition, by kind of data, as upper-case substrings.
CRITERIA = {
    "sepsis": {
        "labs": ("LACTATE", "WBC", "PROCALCITONIN", "CRP", "CREATININE", "BILIRUBIN", "PLATELETS",
                 "INR", "APTT"),
        "vitals": ("TEMPERATURE", "HEART RATE", "RESPIRATORY RATE", "MAP", "SYSTOLIC BP",
                   "O2 SAT", "GCS"),
        "meds": ("ANTIBIOTIC", "VASOPRESSOR", "NOREPINEPHRINE", "EPINEPHRINE", "FLUID"),
        "procedures": ("BLOOD CULTURE", "CENTRAL LINE", "ARTERIAL LINE"),
    },
    "pneumonia": {
        "labs": ("WBC", "PROCALCITONIN", "CRP", "LACTATE", "BNP"),
        "vitals": ("TEMPERATURE", "RESPIRATORY RATE", "O2 SAT", "HEART RATE"),
        "meds": ("ANTIBIOTIC", "OXYGEN", "BRONCHODILATOR"),
        "procedures": ("CHEST X-RAY", "CT CHEST", "SPUTUM CULTURE", "BLOOD CULTURE"),
    },
    "cardiac": {
        "labs": ("TROPONIN", "BNP", "CK-MB", "CREATININE", "POTASSIUM"),
        "vitals": ("HEART RATE", "SYSTOLIC BP", "DIASTOLIC BP", "O2 SAT"),
        "meds": ("ANTICOAGULANT", "BETA BLOCKER", "ACE INHIBITOR", "STATIN"),
        "procedures": ("EKG", "ECHO", "CARDIAC CATH", "STRESS TEST"),
    },
    "default": {
        "labs": ("WBC", "HEMOGLOBIN", "CREATININE", "GLUCOSE", "LACTATE"),
        "vitals": ("TEMPERATURE", "HEART RATE", "RESPIRATORY RATE", "SYSTOLIC BP", "O2 SAT"),
        "meds": (),
        "procedures": (),
    },
}


def criteria_hit(
    condition: Column, data_type: Column, name: Column, criteria: dict | None = None
) -> Column:
    """Whether a structured row is evidence for the condition, as one expression, without a join."""
    criteria = CRITERIA if criteria is None else criteria
    upper = F.upper(name)
    known = F.when(condition.isin(*criteria), condition).otherwise("default")
    result = F.lit(False)
    for type_name, kinds in criteria.items():
        for kind, words in kinds.items():
            if words:
                hit = any_of([upper.contains(w) for w in words])
                result = result | ((known == type_name) & (data_type == kind) & hit)
    return F.coalesce(result, F.lit(False))


def search_tags(
    original_drg: Column, proposed_drg: Column, is_sepsis: Column, reason_types: Column
) -> Column:
    """Tags to filter a library by: DRGs, the condition's tags, the kinds of reason."""

    def drg(code: Column) -> Column:
        return F.when(F.nullif(code, F.lit("")).isNotNull(), F.concat(F.lit("drg_"), code))

    condition = F.when(
        is_sepsis, F.array(*[F.lit(t) for t in ("sepsis", "severe_sepsis", "septic_shock")])
    ).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(
        F.coalesce(reason_types, F.array().cast("array<string>")),
        lambda t: F.coalesce(t, F.lit("unknown")),
    )
    return F.concat(F.array_compact(F.array(drg(original_drg), drg(proposed_drg))), condition, kinds)


def query_text(reasons: Column) -> Column:
    """Summaries and arguments of all reasons as one search text.

    ``reasons``: array of struct ``(summary, arguments)``.
    """
    parts = F.flatten(
        F.transform(
            reasons,
            lambda r: F.concat(
                F.array_compact(F.array(F.nullif(r["summary"], F.lit("")))),
                F.coalesce(r["arguments"], F.array().cast("array<string>")),
            ),
        )
    )
    return F.array_join(parts, " ")


# --- duplicates -------------------------------------------------------------------------------

# Fixed value: letters that agree so far open alike.
OPENING_CHARS = 200


def fingerprints(letters: DataFrame, opening_chars: int = OPENING_CHARS) -> DataFrame:
    """``(doc_id, exact_key, partial_key)``: hashes of the whole normalised text and of its opening.

    Two letters are the same if all of their text is; "opens alike" is a weaker mark of its own.
    Rows are small to shuffle.
    """
    return letters.select(
        "doc_id",
        F.sha2(squeeze(F.col("text")), 256).alias("exact_key"),
        F.sha2(opening(F.col("text"), opening_chars), 256).alias("partial_key"),
    )


def matched_letters(samples: DataFrame, library: DataFrame) -> DataFrame:
    """For each sample how many library letters are the same or open alike, and the first of them."""
    return _matched(fingerprints(samples), fingerprints(library), same=False)


def duplicate_letters(prints: DataFrame) -> DataFrame:
    """For each letter how many others are the same or open alike, and the first of its group.

    ``first_doc_id`` names the group: its members are the rows that share it and ``match_type``.

    Takes the table of ``fingerprints``, which is read twice: stage it, it is small and the texts
    are long.
    """
    return _matched(prints, prints, same=True)


def _matched(prints: DataFrame, found: DataFrame, same: bool) -> DataFrame:
    """EXACT beats PARTIAL. The library is counted per opening first, so a group of copies is one
    row and no pairs are formed, however large it is."""
    both = found.groupBy("partial_key", "exact_key").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id")
    )
    exact = both.select("exact_key", F.col("n").alias("n_exact"), F.col("first_id").alias("e_id"))
    partial = both.groupBy("partial_key").agg(
        F.sum("n").alias("n_opening"),
        F.min("first_id").alias("p_id"),
        F.count("*").alias("n_texts"),
    )
    if same:
        # only openings that occur more than once can match
        exact, partial = exact.filter("n_exact > 1"), partial.filter("n_opening > 1")
    own = F.lit(1 if same else 0)
    n_exact = F.greatest(F.coalesce("n_exact", F.lit(0)) - own, F.lit(0))
    opened = F.greatest(F.coalesce("n_opening", F.lit(0)) - own, F.lit(0))
    joined = prints.join(exact, "exact_key", "left").join(partial, "partial_key", "left")
    return (
        joined.select(
            "doc_id",
            n_exact.alias("n_exact"),
            (opened - n_exact).alias("n_partial"),
            F.when(n_exact > 0, "EXACT").otherwise("PARTIAL").alias("match_type"),
            F.when(n_exact > 0, F.col("e_id")).otherwise(F.col("p_id")).alias("first_doc_id"),
        )
        .filter("n_exact > 0 or n_partial > 0")
    )


def group_members(prints: DataFrame) -> DataFrame:
    """``(doc_id, group_id, group_size)`` of letters whose whole text others have: every member, no pairs."""
    groups = prints.groupBy("exact_key").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return prints.join(groups.filter("group_size > 1"), "exact_key").select("doc_id", "group_id", "group_size")


# Characters of a segment: short, so that a differing character spoils little.
SEGMENT = 5


def similar_letters(documents: DataFrame, text: str = "text", chars: int = 200, percent: int = 95) -> DataFrame:
    """Letters whose openings agree at ``percent`` of their places: (doc_id, n_same, n_similar, first_doc_id).

    An opening is the first ``chars`` characters as ``functions.text.opening`` has them; openings of one length
    are compared. ``n_same`` counts other letters of the same opening, ``n_similar`` those of one alike, and
    ``first_doc_id`` is the lowest id among them all. Letters without either are left out.

    Equal openings are one row, so n copies cost n. Openings are cut into segments. Where at most k
    characters differ, at most k segments do, so with the segments in one order, rare ones first, two openings
    that are alike share one of their first k + 1. Only those meet: what most letters have in common brings
    nobody together. What meets is then compared as a whole, and no pair is lost.
    """
    opened = documents.select("doc_id", opening(F.col(text), chars).alias("opening")).filter("opening <> ''")
    groups = staged(opened.groupBy("opening").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    size = F.length("opening")
    spare = F.floor((100 - percent) * size / 100).cast("int").alias("spare")
    starts = F.sequence(F.lit(1), size, F.lit(SEGMENT))
    segments = F.transform(starts, lambda s: F.struct(size.alias("size"), s.alias("at"), F.substring("opening", s, F.lit(SEGMENT)).alias("part")))
    rows = groups.select("first_id", spare, F.explode(segments).alias("segment"))
    often = rows.groupBy("segment").agg(F.count("*").alias("held")).filter("held > 1")
    # a segment that no other opening has stands first and meets nobody
    ranked = rows.join(often, "segment", "left").groupBy("first_id", "spare").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "segment"))).alias("all")
    )
    first = ranked.select("first_id", F.explode(F.slice("all", F.lit(1), F.col("spare") + 1)).alias("one"))
    shown = staged(first.filter("one.held > 1").select("first_id", "one.segment"))
    a, b = shown.alias("a"), shown.alias("b")
    met = a.join(b, (F.col("a.segment") == F.col("b.segment")) & (F.col("a.first_id") < F.col("b.first_id")))
    pairs = met.select(F.col("a.first_id").alias("a_id"), F.col("b.first_id").alias("b_id")).distinct()
    for side in ("a", "b"):
        own = groups.select(F.col("first_id").alias(f"{side}_id"), F.col("opening").alias(side), F.col("n").alias(f"{side}_n"))
        pairs = pairs.join(own, f"{side}_id")
    differ = F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: x != y)
    alike = pairs.filter(100 * F.size(F.filter(differ, lambda x: x)) <= (100 - percent) * F.length("a"))
    both = staged(alike.select("a_id", "b_id", "a_n", "b_n"))
    ends = both.select(F.col("a_id").alias("first_id"), F.col("b_id").alias("other"), F.col("b_n").alias("more")).unionByName(
        both.select(F.col("b_id").alias("first_id"), F.col("a_id").alias("other"), F.col("a_n").alias("more"))
    )
    counted = ends.groupBy("first_id").agg(F.sum("more").alias("n_similar"), F.min("other").alias("other"))
    found = groups.join(counted, "first_id", "left").filter("n > 1 or n_similar is not null")
    return opened.join(found, "opening").select(
        "doc_id",
        (F.col("n") - 1).alias("n_same"),
        F.coalesce("n_similar", F.lit(0)).alias("n_similar"),
        F.least("first_id", F.coalesce("other", F.col("first_id"))).alias("first_doc_id"),
    )


# --- scan quality -----------------------------------------------------------------------------

# Steps of the density and line scores, their weights and the usability limits.
DENSITY_STEPS = ((50, 1.0), (100, 0.8), (200, 0.4))
LINE_STEPS = ((5, 1.0), (10, 0.6), (20, 0.3))
WEIGHTS = (0.5, 0.3, 0.2)
SCANNED_ABOVE, MIN_CHARS = 0.7, 50
NEVER_SCANNED = ("docx", "doc")


def page_metrics(pages: DataFrame) -> DataFrame:
    """Pages, lines and characters per document; lines are counted as joined by line breaks."""
    lines = F.size(F.split("page_text", "\n"))
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.sum(lines).alias("total_lines"),
        # the text of a document joins its pages by one line break each
        (F.sum(F.length("page_text")) + F.count("*") - 1).alias("char_count"),
    )


def scan_confidence(
    file_type: Column, pages: Column, lines: Column, chars: Column,
    handwritten: Column, spans: Column,
) -> Column:
    """How likely a document is a scan, 0 to 1, from text density, lines and handwriting."""

    def step(value: Column, steps: Sequence[tuple[int, float]]) -> Column:
        result = F.when(F.lit(False), 0.0)
        for limit, score in steps:
            result = result.when(value < limit, score)
        return result.otherwise(0.0)

    density = step(F.try_divide(chars, pages), DENSITY_STEPS)
    line = step(F.try_divide(lines, pages), LINE_STEPS)
    hand = F.coalesce(F.try_divide(handwritten, spans), F.lit(0.0))
    weighted = WEIGHTS[0] * density + WEIGHTS[1] * line + WEIGHTS[2] * hand
    return (
        F.when(F.lower(file_type).isin(*NEVER_SCANNED), 0.0)
        .when(F.coalesce(pages, F.lit(0)) == 0, 1.0)
        .otherwise(F.least(weighted, F.lit(1.0)))
    )


def usability(metrics: DataFrame) -> DataFrame:
    """Adds ``is_scanned``, ``is_usable`` and ``skip_reason`` to ``scan_confidence`` and counts."""
    scanned = F.col("scan_confidence") > SCANNED_ABOVE
    enough = F.col("char_count") >= MIN_CHARS
    percent = fixed(F.col("scan_confidence") * 100, 0)
    chars = F.col("char_count").cast("string")
    return metrics.select(
        "*",
        scanned.alias("is_scanned"),
        (~scanned & enough).alias("is_usable"),
        F.when(
            scanned,
            F.concat(F.lit("Likely scanned document (confidence: "), percent, F.lit("%)")),
        )
        .when(~enough, F.concat(F.lit("Insufficient text extracted ("), chars, F.lit(" chars)")))
        .alias("skip_reason"),
    )
