"""Event tables out of warehouse tables, for many accounts at once.

The cases come in as a DataFrame; ``target_encounters`` restricts the warehouse to them by a
semi-join, and every extract joins on the encounters it gives. Joins carry no broadcast hints:
Spark broadcasts a side it has measured to be small and shuffles otherwise, and adaptive
execution splits the join partition of an encounter that owns many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import NO_ID
from caseflow.functions.times import (
    age,
    micros,
    midnights,
    recorded,
    service_dates,
    timing,
    us_date,
)
from caseflow.operators.slices import same_key
from caseflow.operators.textparts import PART_CHARS, long_keys, text_parts
from caseflow.sources.sinks import staged

# Codes of final, verified results.
FINAL_ORDER, FINAL_LAB, FINAL_RESULT, NO_RESULT = 5, (3, 5), 9, "-1"

# Flowsheet measures that count as vital signs.
VITAL_IDS = ("5", "6", "8", "9", "10", "11", "14", "1525", "1050046701", "1050056801")

# Actions by which a dose reached the patient.
GIVEN_ACTIONS = (
    "Given", "Patient/Family Admin", "Given-See Override",
    "Admin by Another Clinician (Comment)", "New Bag", "Bolus", "Push",
    "Started by Another Clinician", "Bag Switched", "Clinic Sample Administered",
    "Applied", "Feeding Started", "Acknowledged", "Contrast Given",
    "New Bag-See Override", "Bolus from Bag",
)

# Diet orders that count as procedures.
DIET_PROCEDURES = (
    "DIET NPO", "DIET TUBE FEEDING", "DIET CALORIE CONTROLLED",
    "DIET COMPLEX CARB", "DIET KETOGENIC", "DIET DIABETIC",
)

ENCOUNTER = ("account_id", "encounter_id")


def target_encounters(encounters: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Encounters ``(account_id, encounter_id, patient_id, start_ts, end_ts)`` of the cases."""
    rows = encounters.select("account_id", "encounter_id", "patient_id", "start_ts", "end_ts")
    if cases is None:
        return rows
    return rows.join(cases.select("account_id").distinct(), "account_id", "left_semi")


def labs(
    encounters: DataFrame,
    orders: DataFrame,
    results: DataFrame,
    components: DataFrame,
    component_names: DataFrame,
    abnormal_names: DataFrame,
) -> DataFrame:
    """Final, verified lab results with their component name and abnormal flag."""
    final_orders = orders.filter(
        (F.col("order_status") == FINAL_ORDER) & F.col("lab_status").isin(*FINAL_LAB)
    ).select("encounter_id", "order_id")
    final_results = results.filter(F.col("result_status") == FINAL_RESULT).select(
        "order_id", "result_id"
    )
    values = components.filter(F.col("value").isNotNull() & (F.col("value") != NO_RESULT)).select(
        "result_id", "component_id", "value", "units", "abnormal_code", "verified_ts"
    )
    return (
        encounters.select(*ENCOUNTER)
        .join(final_orders, "encounter_id")
        .join(final_results, "order_id")
        .join(values, "result_id")
        .join(component_names.select("component_id", "lab_name"), "component_id")
        .join(abnormal_names.select("abnormal_code", "abnormal_flag"), "abnormal_code", "left")
        .select(
            *ENCOUNTER,
            F.col("verified_ts").cast("timestamp").alias("event_ts"),
            "lab_name",
            F.replace(F.col("value").cast("string"), F.lit(">"), F.lit("")).alias("lab_value"),
            F.col("units").alias("lab_units"),
            "abnormal_flag",
        )
    )


def vitals(
    encounters: DataFrame, flowsheet: DataFrame, measure_ids: Sequence[str] = VITAL_IDS
) -> DataFrame:
    rows = flowsheet.filter(
        F.col("measure_id").isin(*measure_ids) & F.col("measure_value").isNotNull()
    )
    return (
        encounters.select(*ENCOUNTER)
        .join(rows, "encounter_id")
        .select(
            *ENCOUNTER,
            recorded(F.col("recorded_time")).alias("event_ts"),
            F.col("measure_name").alias("vital_name"),
            F.col("measure_value").alias("vital_value"),
        )
    )


def meds(
    encounters: DataFrame,
    med_orders: DataFrame,
    administrations: DataFrame,
    actions: Sequence[str] = GIVEN_ACTIONS,
) -> DataFrame:
    given = administrations.filter(F.col("action").isin(*actions))
    return (
        encounters.select(*ENCOUNTER)
        .join(med_orders, "encounter_id")
        .join(given, "order_med_id")
        .select(
            *ENCOUNTER,
            F.col("taken_ts").cast("timestamp").alias("event_ts"),
            F.col("generic_name").alias("med_name"),
            F.col("dose").cast("string").alias("med_dose"),
            F.col("dose_unit").alias("med_units"),
            F.col("route").alias("med_route"),
            F.col("action").alias("admin_action"),
        )
    )


def procedures(
    encounters: DataFrame, orders: DataFrame, names: Sequence[str] = DIET_PROCEDURES
) -> DataFrame:
    done = orders.filter(
        F.col("proc_name").isin(*names)
        & (F.col("order_status") == FINAL_ORDER)
        & F.col("start_ts").isNotNull()
    ).select("encounter_id", "order_id", "proc_name", F.col("start_ts").alias("_start"))
    return (
        encounters.select(*ENCOUNTER)
        .join(done, "encounter_id")
        .select(
            *ENCOUNTER,
            F.col("_start").cast("timestamp").alias("event_ts"),
            F.col("proc_name").alias("procedure_name"),
            F.col("order_id").cast("string").alias("procedure_code"),
        )
    )


def _diagnosis_branches(
    encounters: DataFrame,
    encounter_dx: DataFrame,
    contacts: DataFrame,
    account_dx: DataFrame,
    discharges: DataFrame,
    problems: DataFrame,
    dictionary: DataFrame,
    same_account_only: bool,
    once: bool = False,
) -> DataFrame:
    """The three diagnosis sources in one shape, with the encounter's bounds.

    With ``once`` equal diagnoses of a patient fall together before they meet the patient's stays.
    """
    names = dictionary.select("dx_id", "dx_name")
    bounds = [*ENCOUNTER, "patient_id", "start_ts", "end_ts"]
    out = ["account_id", "encounter_id", "start_ts", "end_ts", "dx_id", "dx_name", "icd10_code"]

    outpatient = (
        encounters.select(*bounds)
        .join(encounter_dx.select("encounter_id", "dx_id", "icd10_code"), "encounter_id")
        .join(contacts.select("encounter_id", "contact_date"), "encounter_id")
        .join(names, "dx_id", "left")
        .select(
            *out,
            F.col("contact_date").cast("timestamp").alias("event_ts"),
            F.lit("OUTPATIENT_ENC_DX").alias("source"),
            F.lit(None).cast("int").alias("poa_code"),
        )
    )
    billed = (
        account_dx.select(
            "patient_id", F.col("account_id").alias("dx_account"), "dx_id", "icd10_code", "poa_code"
        )
        .join(
            discharges.select(F.col("account_id").alias("dx_account"), "discharge_ts"), "dx_account"
        )
        .join(names, "dx_id", "left")
    )
    listed = problems.filter(F.col("status") == "Active").select(
        "patient_id", "problem_id", "problem_name", "problem_icd10_code", "entry_date"
    )
    if once:
        listed = listed.distinct()
        billed = (billed if same_account_only else billed.drop("dx_account")).distinct()
    if same_account_only:
        # a stay meets the diagnoses of its own account only
        own = billed.withColumnRenamed("dx_account", "account_id")
        inpatient = encounters.select(*bounds).join(own, ["patient_id", "account_id"])
    else:
        inpatient = encounters.select(*bounds).join(billed, "patient_id")
    inpatient = inpatient.select(
        *out,
        F.col("discharge_ts").cast("timestamp").alias("event_ts"),
        F.lit("INPATIENT_ACCT_DX").alias("source"),
        F.col("poa_code").cast("int").alias("poa_code"),
    )
    problem_list = (
        encounters.select(*bounds)
        .join(listed, "patient_id")
        .select(
            "account_id",
            "encounter_id",
            "start_ts",
            "end_ts",
            F.col("problem_id").alias("dx_id"),
            F.col("problem_name").alias("dx_name"),
            F.col("problem_icd10_code").alias("icd10_code"),
            F.col("entry_date").cast("timestamp").alias("event_ts"),
            F.lit("PROBLEM_LIST").alias("source"),
            F.lit(None).cast("int").alias("poa_code"),
        )
    )
    return outpatient.unionByName(inpatient).unionByName(problem_list)


def diagnoses(
    encounters: DataFrame,
    encounter_dx: DataFrame,
    contacts: DataFrame,
    account_dx: DataFrame,
    discharges: DataFrame,
    problems: DataFrame,
    dictionary: DataFrame,
    same_account_only: bool = False,
) -> DataFrame:
    """Distinct diagnoses of encounter, account and problem list, with present-on-admission code.

    Account and problem rows are found through the patient, so they include other stays;
    ``same_account_only`` keeps the account's own.
    """
    rows = _diagnosis_branches(
        encounters, encounter_dx, contacts, account_dx, discharges, problems, dictionary,
        same_account_only, once=True,
    )
    return (
        rows.filter(
            F.col("dx_id").isNotNull()
            & (F.col("dx_name").isNotNull() | F.col("icd10_code").isNotNull())
        )
        .select(
            *ENCOUNTER, "dx_id", "dx_name", "icd10_code", "event_ts", "source", "poa_code"
        )
        .distinct()
    )


def diagnosis_timing(
    encounters: DataFrame,
    encounter_dx: DataFrame,
    contacts: DataFrame,
    account_dx: DataFrame,
    discharges: DataFrame,
    problems: DataFrame,
    dictionary: DataFrame,
) -> DataFrame:
    """Coded diagnoses placed BEFORE or DURING the encounter; later ones are left out."""
    rows = _diagnosis_branches(
        encounters, encounter_dx, contacts, account_dx, discharges, problems, dictionary, False
    )
    placed = rows.filter(F.col("icd10_code").isNotNull()).withColumn(
        "timing_category", timing(F.col("event_ts"), F.col("start_ts"), F.col("end_ts"))
    )
    return placed.filter(F.col("timing_category") != "AFTER").select(
        *ENCOUNTER,
        "icd10_code",
        F.col("dx_name").alias("icd10_description"),
        "timing_category",
        F.when(F.col("timing_category") == "BEFORE", "Available at encounter start")
        .otherwise(F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("availability_time"),
        "event_ts",
        "source",
    )


def timings_in_order(timed: DataFrame) -> DataFrame:
    """For a reader of few accounts: what came up during the stay, then what was there before."""
    return timed.orderBy("account_id", F.col("timing_category").desc(), "event_ts", "icd10_code")


def poa_anchor(diagnosis_rows: DataFrame, predicate: str) -> DataFrame:
    """Per account the earliest billed diagnosis of the condition: ``poa_code, first_dx_ts``."""
    rows = diagnosis_rows.filter(
        (F.col("source") == "INPATIENT_ACCT_DX") & F.col("poa_code").isNotNull()
    ).filter(F.expr(predicate))
    order = F.struct(F.col("event_ts").isNotNull(), micros(F.col("event_ts")), F.col("poa_code"))
    return rows.groupBy("account_id").agg(
        F.min_by("poa_code", order).alias("poa_code"),
        F.min_by("event_ts", order).alias("first_dx_ts"),
    )


def patient_header(accounts: DataFrame, patients: DataFrame, facility: Column) -> DataFrame:
    """Name, birth date, facility, midnights and dates of service per account."""
    return accounts.join(patients, "patient_id").select(
        "account_id",
        "patient_id",
        "mrn",
        F.concat("first_name", F.lit(" "), "last_name").alias("formatted_name"),
        us_date(F.col("birth_date")).alias("formatted_birthdate"),
        facility.alias("facility_name"),
        midnights(F.col("admit_ts"), F.col("discharge_ts")).alias("number_of_midnights"),
        age(F.col("birth_date"), F.col("discharge_ts")).alias("age_at_discharge"),
        service_dates(F.col("admit_ts"), F.col("discharge_ts")).alias("formatted_date_of_service"),
    )


def facility_of(location: Column) -> Column:
    """A location's display name without its organisational prefix."""
    return F.initcap(F.trim(F.regexp_replace(location, r"^PARENT\s+", "")))


def principal_line(rows: DataFrame, line: str = "line") -> DataFrame:
    return rows.filter(F.col(line) == 1)


# The three kinds of claim id, in the order in which they are named.
CLAIM_IDS = ("icn", "icn_no", "control_no")
CLAIM_ID_SEP = ", "


def claim_rollup(claims: DataFrame) -> DataFrame:
    """Per account the highest tax id and NPI, and one claim id of each kind."""
    picked = F.array(*[F.min(c) for c in CLAIM_IDS])
    return claims.groupBy("account_id").agg(
        F.max("tax_id").alias("tax_id"),
        F.max("npi").alias("npi"),
        F.count("*").alias("n_claims"),
        F.array_join(F.array_distinct(F.array_compact(picked)), ", ").alias("all_claim_ids"),
    )


def claim_id_lists(
    claims: DataFrame, position: Column, width: int, part_chars: int = PART_CHARS
) -> DataFrame:
    """All claim ids of an account as a list per kind, in claim order, in parts of bounded size.

    The ids of all kinds of an account are gathered together, which shuffles a claim once. Only accounts whose
    ids are long are taken apart before.
    """
    rows = staged(claims.select("account_id", position.alias("_at"), *[F.col(c).cast("string").alias(c) for c in CLAIM_IDS]))
    chars = [F.coalesce(F.length(c) + len(CLAIM_ID_SEP), F.lit(0)) for c in CLAIM_IDS]
    long = long_keys(rows, ["account_id"], sum(chars, F.lit(0)), part_chars)
    short = rows if long is None else same_key(rows, long, ["account_id"], "left_anti")
    gathered = short.repartition("account_id").groupBy("account_id").agg(
        F.collect_list(F.struct("_at", *CLAIM_IDS)).alias("_all")
    )

    def ids(kind: str) -> Column:
        stated = F.filter(F.col("_all"), lambda x: x[kind].isNotNull())
        return F.array_sort(F.transform(stated, lambda x: F.struct(x["_at"].alias("at"), x[kind].alias("id"))))

    lists = F.array(*[F.struct(F.lit(c).alias("id_kind"), ids(c).alias("ids")) for c in CLAIM_IDS])
    out = gathered.select("account_id", F.inline(lists)).filter(F.size("ids") > 0).select(
        "account_id",
        "id_kind",
        F.lit(0).alias("part_no"),
        F.size("ids").cast("long").alias("n_rows"),
        F.concat_ws(CLAIM_ID_SEP, F.col("ids.id")).alias("claim_ids"),
    )
    if long is None:
        return out
    kinds = F.array(*[F.struct(F.lit(c).alias("id_kind"), F.col(c).alias("claim_id")) for c in CLAIM_IDS])
    apart = same_key(rows, long, ["account_id"], "left_semi").select("account_id", "_at", F.inline(kinds))
    parts = text_parts(
        apart.filter(F.col("claim_id").isNotNull()),
        ["account_id", "id_kind"],
        F.col("claim_id"),
        CLAIM_ID_SEP,
        F.col("_at"),
        [F.col("claim_id")],
        part_chars,
        width,
    )
    return out.unionByName(parts.withColumnRenamed("text", "claim_ids"))


def with_id_defaults(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(NO_ID)) for c in columns}
    )
