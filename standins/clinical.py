"""Stand-ins for the clinical tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standins.registry import Tables

# --- timeline: labs, vitals and doses are events, diagnoses are orders, procedures shipments -----


def timeline_labs(t: Tables) -> DataFrame:
    return t.events.filter("event_type in ('click', 'view', 'signup')").select(
        F.col("user_id").alias("account_id"),
        F.col("user_id").alias("encounter_id"),
        F.col("ts").alias("event_ts"),
        F.col("event_type").alias("lab_name"),
        F.col("value").cast("string").alias("lab_value"),
        F.when(F.col("event_type") != "click", "mg/dL").alias("lab_units"),
        F.when(F.col("value") > 100, "High").alias("abnormal_flag"),
    )


def timeline_vitals(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("account_id"),
        F.col("user_id").alias("encounter_id"),
        F.col("ts").alias("event_ts"),
        F.col("event_type").alias("vital_name"),
        F.col("value").cast("string").alias("vital_value"),
    )


DRUGS = (
    "Norepinephrine 4 mg", "Epinephrine", "DOPamine HCl", "Dobutamine", "Vasopressin", "Levophed",
)


def meds(t: Tables) -> DataFrame:
    drug = F.element_at(
        F.array(*[F.lit(d) for d in DRUGS]), (F.pmod("event_id", F.lit(6)) + 1).cast("int")
    )
    return t.events.filter("event_type = 'error'").select(
        F.col("user_id").alias("account_id"),
        F.col("user_id").alias("encounter_id"),
        F.col("ts").alias("event_ts"),
        drug.alias("med_name"),
        F.when(F.pmod("event_id", F.lit(7)) != 0, (F.col("value") / 10).cast("string")).alias(
            "med_dose"
        ),
        F.lit("mcg/kg/min").alias("med_units"),
        F.when(F.col("value") > 50, "IV").alias("med_route"),
        F.lit("New Bag").alias("admin_action"),
    )


def timeline_diagnoses(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_custkey").alias("encounter_id"),
        F.when(F.col("o_orderstatus") != "P", F.left("o_orderpriority", F.lit(1))).alias(
            "icd10_code"
        ),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("dx_name"),
        F.col("o_orderdate").alias("event_ts"),
    )


def timeline_procedures(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("account_id"),
        F.col("l_orderkey").alias("encounter_id"),
        F.col("l_shipdate").alias("event_ts"),
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("procedure_name"),
    )


SQL_DRUG = (
    "CASE event_id % 6 "
    + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DRUGS))
    + " END"
)

SQL_TIMELINE = f"""
raw_events AS (
  SELECT user_id AS account_id, user_id AS encounter_id, ts AS event_ts, 'LAB' AS event_type,
         event_type || ': ' || CAST(value AS VARCHAR) || ' '
           || CASE WHEN event_type <> 'click' THEN 'mg/dL' ELSE '' END
           || CASE WHEN value > 100 THEN ' (High)' ELSE '' END AS event_detail,
         CASE WHEN value > 100 THEN 1 ELSE 0 END AS is_abnormal
  FROM events WHERE event_type IN ('click', 'view', 'signup')
  UNION ALL
  SELECT user_id, user_id, ts, 'VITAL', event_type || ': ' || CAST(value AS VARCHAR), 0
  FROM events WHERE event_type = 'purchase'
  UNION ALL
  SELECT user_id, user_id, ts, 'MEDICATION',
         {SQL_DRUG} || ' '
           || CASE WHEN event_id % 7 <> 0 THEN CAST(value / 10 AS VARCHAR) ELSE '' END
           || ' mcg/kg/min via ' || CASE WHEN value > 50 THEN 'IV' ELSE 'unknown' END
           || ' - New Bag', 0
  FROM events WHERE event_type = 'error'
  UNION ALL
  SELECT l_orderkey, l_orderkey, l_shipdate, 'PROCEDURE', l_returnflag || '-' || l_linestatus, 0
  FROM lineitem
  UNION ALL
  SELECT o_custkey, o_custkey, o_orderdate, 'DIAGNOSIS',
         CASE WHEN o_orderstatus <> 'P' THEN left(o_orderpriority, 1) ELSE '' END
           || CASE WHEN o_orderstatus NOT IN ('P', 'O') THEN ' - ' ELSE '' END
           || CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority ELSE 'Unknown diagnosis' END, 0
  FROM orders WHERE o_orderdate IS NOT NULL
),
timeline AS (
  SELECT account_id, encounter_id, event_ts, event_type, event_detail,
         max(is_abnormal) AS is_abnormal
  FROM raw_events GROUP BY ALL
)"""

# --- diagnoses: encounters are customers' open orders, codes come from orders and lines ----------


def encounters(t: Tables) -> DataFrame:
    spans = (
        t.orders.filter("o_orderstatus = 'O'")
        .groupBy("o_custkey")
        .agg(F.min("o_orderdate").alias("start_ts"), F.max("o_orderdate").alias("last_ts"))
    )
    return t.customer.join(spans, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_custkey").alias("encounter_id"),
        F.col("c_custkey").alias("patient_id"),
        "start_ts",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("last_ts")).alias("end_ts"),
    )


def diagnosis_sources(t: Tables) -> dict[str, DataFrame]:
    o, li = t.orders, t.lineitem
    return {
        "encounters": encounters(t),
        "encounter_dx": o.select(
            F.col("o_custkey").alias("encounter_id"),
            F.col("o_orderkey").alias("dx_id"),
            F.col("o_orderpriority").alias("icd10_code"),
        ),
        "contacts": o.groupBy(F.col("o_custkey").alias("encounter_id")).agg(
            F.min("o_orderdate").alias("contact_date")
        ),
        "account_dx": li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("patient_id"),
            F.col("l_orderkey").alias("account_id"),
            F.col("l_partkey").alias("dx_id"),
            F.concat("l_returnflag", "l_linestatus").alias("icd10_code"),
            F.col("l_linenumber").alias("poa_code"),
        ),
        "discharges": o.select(
            F.col("o_orderkey").alias("account_id"), F.col("o_orderdate").alias("discharge_ts")
        ),
        "problems": o.select(
            F.col("o_custkey").alias("patient_id"),
            F.col("o_orderkey").alias("problem_id"),
            F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("problem_name"),
            F.when(F.col("o_totalprice") > 50000, F.lit("P1")).alias("problem_icd10_code"),
            F.col("o_orderdate").alias("entry_date"),
            F.when(F.col("o_orderstatus") == "P", "Active").otherwise("Resolved").alias("status"),
        ),
        "dictionary": t.part.select(
            F.col("p_partkey").alias("dx_id"), F.col("p_name").alias("dx_name")
        ),
    }


SQL_ENCOUNTERS = """
encounters AS (
  SELECT c_custkey AS account_id, c_custkey AS encounter_id, c_custkey AS patient_id,
         min(o_orderdate) AS start_ts,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN max(o_orderdate) END AS end_ts
  FROM customer JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O'
  GROUP BY c_custkey, c_mktsegment
)"""

SQL_DIAGNOSES = (
    SQL_ENCOUNTERS
    + """,
dx_rows AS (
  SELECT e.*, o_orderkey AS dx_id, p_name AS dx_name, o_orderpriority AS icd10_code,
         c.contact_date AS event_ts, 'OUTPATIENT_ENC_DX' AS source, CAST(NULL AS INTEGER) AS poa_code
  FROM encounters e JOIN orders ON o_custkey = e.encounter_id
  JOIN (SELECT o_custkey AS k, min(o_orderdate) AS contact_date FROM orders GROUP BY 1) c
    ON c.k = e.encounter_id
  LEFT JOIN part ON p_partkey = o_orderkey
  UNION ALL
  SELECT e.*, l_partkey, p_name, l_returnflag || l_linestatus, o_orderdate, 'INPATIENT_ACCT_DX',
         l_linenumber
  FROM encounters e JOIN orders ON o_custkey = e.patient_id
  JOIN lineitem ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = l_partkey
  UNION ALL
  SELECT e.*, o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_orderpriority END,
         CASE WHEN o_totalprice > 50000 THEN 'P1' END, o_orderdate, 'PROBLEM_LIST', NULL
  FROM encounters e JOIN orders ON o_custkey = e.patient_id AND o_orderstatus = 'P'
)"""
)

SQL_TIMED = (
    SQL_DIAGNOSES
    + """,
timed AS (
  SELECT *, CASE WHEN event_ts < start_ts THEN 'BEFORE'
                 WHEN event_ts >= start_ts AND (end_ts IS NULL OR event_ts <= end_ts) THEN 'DURING'
                 ELSE 'AFTER' END AS timing_category
  FROM dx_rows WHERE icd10_code IS NOT NULL
)"""
)

# --- readings: one event may stand for two readings ---------------------------------------------


def reading_labs(t: Tables) -> DataFrame:
    names = F.create_map(
        F.lit("click"), F.array(F.lit("Platelet Count"), F.lit("PO2 ART")),
        F.lit("view"), F.array(F.lit("Bilirubin, Total"), F.lit("FIO2")),
        F.lit("signup"), F.array(F.lit("Creatinine")),
    )
    v = F.col("value")
    value = (
        F.when(F.col("lab_name") == "Bilirubin, Total", v / 25)
        .when(F.col("lab_name") == "FIO2", 21 + v % 80)
        .when(F.col("lab_name") == "Creatinine", v / 60)
        .otherwise(v)
    )
    return (
        t.events.filter("event_type in ('click', 'view', 'signup')")
        .withColumn("lab_name", F.explode(F.try_element_at(names, F.col("event_type"))))
        .select(
            F.col("user_id").alias("account_id"),
            F.col("ts").alias("event_ts"),
            "lab_name",
            value.cast("string").alias("lab_value"),
        )
    )


def reading_vitals(t: Tables) -> DataFrame:
    names = F.create_map(
        F.lit("purchase"), F.array(F.lit("MAP")),
        F.lit("signup"), F.array(F.lit("Glasgow Coma Scale"), F.lit("PEEP")),
    )
    v = F.col("value")
    value = F.when(
        F.col("vital_name") == "Glasgow Coma Scale", (3 + v.cast("int") % 13).cast("double")
    ).otherwise(v)
    return (
        t.events.filter("event_type in ('purchase', 'signup')")
        .withColumn("vital_name", F.explode(F.try_element_at(names, F.col("event_type"))))
        .select(
            F.col("user_id").alias("account_id"),
            F.col("ts").alias("event_ts"),
            "vital_name",
            value.cast("string").alias("vital_value"),
        )
    )


SQL_READINGS = """
readings AS (
  SELECT user_id AS account_id, epoch_us(ts) AS us, ts, event_id, c.category, c.value
  FROM events, LATERAL (
    SELECT 'platelets' AS category, value WHERE event_type = 'click'
    UNION ALL SELECT 'pao2', value WHERE event_type = 'click'
    UNION ALL SELECT 'bilirubin', value / 25 WHERE event_type = 'view'
    UNION ALL SELECT 'fio2', 21 + value % 80 WHERE event_type = 'view'
    UNION ALL SELECT 'creatinine', value / 60 WHERE event_type = 'signup'
    UNION ALL SELECT 'map', value WHERE event_type = 'purchase'
    UNION ALL SELECT 'gcs', CAST(3 + CAST(trunc(value) AS INTEGER) % 13 AS DOUBLE)
              WHERE event_type = 'signup'
    UNION ALL SELECT 'peep', value WHERE event_type = 'signup'
  ) c
)"""


def sql_pairs(name: str, right: str, tolerance_s: int | None, positive: bool = False) -> str:
    """A CTE of each PaO2 reading with its nearest reading of another category."""
    near = "" if tolerance_s is None else f"AND abs(l.us - r.us) <= {tolerance_s}000000"
    above = "AND r.value > 0" if positive else ""
    return f"""
{name} AS (
  SELECT l.account_id, l.us, l.event_id, l.value AS pao2, r.value AS found, r.us AS found_us
  FROM readings l JOIN readings r ON l.account_id = r.account_id AND r.category = '{right}'
    {near} {above}
  WHERE l.category = 'pao2'
  QUALIFY row_number() OVER (PARTITION BY l.account_id, l.event_id
    ORDER BY abs(l.us - r.us), r.us, r.value) = 1
)"""
