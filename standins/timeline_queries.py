"""Extracts, timelines and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions.text import NO_ID, NO_NOTE
from caseflow.functions.times import micros
from caseflow.operators import extract, notes, timeline
from standins import clinical as c
from standins.registry import Tables, query, second

TS = "yyyy-MM-dd HH:mm:ss"


def merged(t: Tables):
    return timeline.merge_timeline(
        timeline.lab_events(c.timeline_labs(t)),
        timeline.vital_events(c.timeline_vitals(t)),
        timeline.med_events(c.meds(t)),
        timeline.procedure_events(c.timeline_procedures(t)),
        timeline.diagnosis_events(c.timeline_diagnoses(t)),
    )


@query(
    "merged_timeline",
    f"""WITH {c.SQL_TIMELINE}
SELECT account_id, encounter_id, epoch_us(event_ts) AS event_us, event_type, event_detail,
       is_abnormal FROM timeline""",
)
def merged_timeline(t: Tables):
    return merged(t).select(
        "account_id", "encounter_id", micros(F.col("event_ts")).alias("event_us"), "event_type",
        "event_detail", "is_abnormal",
    )


@query(
    "sectioned_timeline",
    f"""WITH {c.SQL_TIMED}, {c.SQL_TIMELINE}
SELECT account_id, encounter_id, 'ENCOUNTER_INFO' AS section_type, 0 AS sort_order,
       CAST(NULL AS DOUBLE) AS event_us,
       'Account ID: ' || account_id || chr(10) || 'Encounter: ' || encounter_id || chr(10)
         || 'Admission: ' || {second("start_ts")} || chr(10) || 'Discharge: '
         || coalesce({second("end_ts")}, 'Still admitted') AS content
FROM encounters
UNION ALL
SELECT account_id, encounter_id, 'PRE_EXISTING_DX', 1, epoch_us(event_ts),
       icd10_code || ': ' || coalesce(dx_name, 'Unknown') || ' (' || source || ')'
FROM timed WHERE timing_category = 'BEFORE'
UNION ALL
SELECT account_id, encounter_id, 'TIMELINE_EVENT', 2, epoch_us(event_ts),
       '[' || {second("event_ts")} || '] ' || upper(event_type) || ': ' || event_detail
FROM timeline""",
)
def sectioned_timeline(t: Tables):
    sources = c.diagnosis_sources(t)
    rows = timeline.sectioned_timeline(
        sources["encounters"], extract.diagnosis_timing(**sources), merged(t)
    )
    return rows.select(
        "account_id", "encounter_id", "section_type", "sort_order",
        micros(F.col("event_ts")).cast("double").alias("event_us"), "content",
    )


@query(
    "timeline_text_capped",
    f"""WITH {c.SQL_TIMELINE},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY account_id
    ORDER BY event_ts, event_type, event_detail, encounter_id) AS n FROM timeline
)
SELECT account_id, count(*) AS n_events,
       string_agg('[' || {second("event_ts")} || '] ' || event_type || ': ' || event_detail
         || CASE WHEN is_abnormal = 1 THEN ' (ABNORMAL)' ELSE '' END, chr(10) ORDER BY n)
         AS timeline_text
FROM ranked WHERE n <= 500 GROUP BY account_id""",
)
def timeline_text_capped(t: Tables):
    """The report that shows an account's first 500 events; ``timeline_text`` is the whole."""
    return timeline.timeline_text(merged(t), max_events=500).drop("part_no")


@query(
    "timeline_text",
    f"""WITH {c.SQL_TIMELINE},
texts AS (
  SELECT account_id, count(*) AS n_events,
         string_agg('[' || {second("event_ts")} || '] ' || event_type || ': ' || event_detail
           || CASE WHEN is_abnormal = 1 THEN ' (ABNORMAL)' ELSE '' END, chr(10)
           ORDER BY event_ts, event_type, event_detail, encounter_id) AS timeline_text
  FROM timeline GROUP BY account_id
)
SELECT c_custkey AS account_id, CAST(0 AS INTEGER) AS part_no, coalesce(n_events, 0) AS n_events,
       coalesce(timeline_text, 'No structured data available for this encounter.') AS timeline_text
FROM customer LEFT JOIN texts ON account_id = c_custkey""",
)
def timeline_text(t: Tables):
    accounts = t.customer.select(F.col("c_custkey").alias("account_id"))
    return timeline.timeline_text(merged(t), accounts)


@query(
    "timeline_text_parts",
    f"""WITH {c.SQL_TIMELINE},
lines AS (
  SELECT account_id, event_ts, event_type, event_detail, encounter_id,
         '[' || {second("event_ts")} || '] ' || event_type || ': ' || event_detail
         || CASE WHEN is_abnormal = 1 THEN ' (ABNORMAL)' ELSE '' END AS line
  FROM timeline
),
placed AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY account_id
    ORDER BY event_ts, event_type, event_detail, encounter_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines
)
SELECT account_id, CAST(before // 1000 AS INTEGER) AS part_no, count(*) AS n_events,
       string_agg(line, chr(10) ORDER BY event_ts, event_type, event_detail, encounter_id)
         AS timeline_text
FROM placed GROUP BY 1, 2""",
)
def timeline_text_parts(t: Tables):
    return timeline.timeline_text(merged(t), part_chars=1000)


@query(
    "labs_extract",
    f"""SELECT c_custkey AS account_id, c_custkey AS encounter_id,
       {second("l_shipdate")} AS event_time, p_name AS lab_name,
       replace(CASE WHEN l_quantity > 45 THEN '>' ELSE '' END || CAST(l_quantity AS VARCHAR), '>', '')
         AS lab_value,
       l_linestatus AS lab_units, r_name AS abnormal_flag
FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON p_partkey = l_partkey
LEFT JOIN region ON r_regionkey = l_linenumber
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('3-MEDIUM', '5-LOW') AND l_returnflag = 'R'
  AND l_quantity <> 1""",
)
def labs_extract(t: Tables):
    """Customers are encounters, orders lab orders, lines results, parts components."""
    enc = t.customer.select(
        F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("encounter_id")
    )
    orders = t.orders.select(
        F.col("o_custkey").alias("encounter_id"),
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", 5).otherwise(2).alias("order_status"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("lab_status"),
    )
    # a result holds the lines of one order and return flag, "R" being final
    result_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_returnflag")
    results = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        result_id.alias("result_id"),
        F.when(F.col("l_returnflag") == "R", 9).otherwise(1).alias("result_status"),
    ).distinct()
    mark = F.when(F.col("l_quantity") > 45, ">").otherwise("")
    value = F.when(F.col("l_quantity") == 1, "-1").otherwise(
        F.concat(mark, F.col("l_quantity").cast("string"))
    )
    components = t.lineitem.select(
        result_id.alias("result_id"),
        F.col("l_partkey").alias("component_id"),
        value.alias("value"),
        F.col("l_linestatus").alias("units"),
        F.col("l_linenumber").alias("abnormal_code"),
        F.col("l_shipdate").alias("verified_ts"),
    )
    names = t.part.select(F.col("p_partkey").alias("component_id"), F.col("p_name").alias("lab_name"))
    flags = t.region.select(
        F.col("r_regionkey").alias("abnormal_code"), F.col("r_name").alias("abnormal_flag")
    )
    rows = extract.labs(enc, orders, results, components, names, flags)
    return rows.withColumn("event_time", F.date_format("event_ts", TS)).drop("event_ts")


@query(
    "vitals_extract",
    f"""SELECT user_id AS account_id, user_id AS encounter_id, {second("ts")} AS event_time,
       event_type AS vital_name, CAST(value AS VARCHAR) AS vital_value
FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 1""",
)
def vitals_extract(t: Tables):
    enc = t.events.select(
        F.col("user_id").alias("account_id"), F.col("user_id").alias("encounter_id")
    ).distinct()
    return vitals_rows(t, enc)


def vitals_rows(t: Tables, enc):
    ids = F.when(F.col("event_type") == "purchase", "5").when(
        F.col("event_type") == "signup", "1525"
    )
    sheet = t.events.select(
        F.col("user_id").alias("encounter_id"),
        ids.alias("measure_id"),
        F.col("event_type").alias("measure_name"),
        F.when(F.col("value") >= 1, F.col("value").cast("string")).alias("measure_value"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("recorded_time"),
    )
    rows = extract.vitals(enc, sheet)
    return rows.withColumn("event_time", F.date_format("event_ts", TS)).drop("event_ts")


@query(
    "meds_extract",
    f"""SELECT o_custkey AS account_id, o_orderkey AS encounter_id,
       {second("l_shipdate")} AS event_time, p_name AS med_name,
       CAST(l_quantity AS VARCHAR) AS med_dose, l_linestatus AS med_units,
       p_type AS med_route,
       CASE l_returnflag WHEN 'A' THEN 'Given' WHEN 'R' THEN 'New Bag' END AS admin_action
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE l_returnflag IN ('A', 'R')""",
)
def meds_extract(t: Tables):
    enc = t.orders.select(
        F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("encounter_id")
    )
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn(
        "order_med_id", F.xxhash64(key)
    )
    orders = lines.select(
        F.col("l_orderkey").alias("encounter_id"),
        "order_med_id",
        F.col("p_name").alias("generic_name"),
        F.col("l_quantity").alias("dose"),
        F.col("l_linestatus").alias("dose_unit"),
    )
    action = (
        F.when(F.col("l_returnflag") == "A", "Given")
        .when(F.col("l_returnflag") == "R", "New Bag")
        .otherwise("Held")
    )
    given = lines.select(
        "order_med_id",
        F.col("l_shipdate").alias("taken_ts"),
        F.col("p_type").alias("route"),
        action.alias("action"),
    )
    rows = extract.meds(enc, orders, given)
    return rows.withColumn("event_time", F.date_format("event_ts", TS)).drop("event_ts")


@query(
    "procedures_extract",
    f"""SELECT c_custkey AS account_id, c_custkey AS encounter_id,
       {second("o_orderdate")} AS event_time, o_orderpriority AS procedure_name,
       CAST(o_orderkey AS VARCHAR) AS procedure_code
FROM customer JOIN orders ON o_custkey = c_custkey
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'""",
)
def procedures_extract(t: Tables):
    enc = t.customer.select(
        F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("encounter_id")
    )
    orders = t.orders.select(
        F.col("o_custkey").alias("encounter_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderpriority").alias("proc_name"),
        F.when(F.col("o_orderstatus") == "F", 5).otherwise(2).alias("order_status"),
        F.col("o_orderdate").alias("start_ts"),
    )
    rows = extract.procedures(enc, orders, ("1-URGENT", "2-HIGH"))
    return rows.withColumn("event_time", F.date_format("event_ts", TS)).drop("event_ts")


@query(
    "diagnoses_union",
    f"""WITH {c.SQL_DIAGNOSES}
SELECT DISTINCT account_id, encounter_id, dx_id, dx_name, icd10_code,
       {second("event_ts")} AS event_time, source, CAST(poa_code AS DOUBLE) AS poa_code
FROM dx_rows WHERE dx_name IS NOT NULL OR icd10_code IS NOT NULL""",
)
def diagnoses_union(t: Tables):
    rows = extract.diagnoses(**c.diagnosis_sources(t))
    return rows.withColumns(
        {
            "event_time": F.date_format("event_ts", TS),
            "poa_code": F.col("poa_code").cast("double"),
        }
    ).drop("event_ts")


@query(
    "diagnosis_timing",
    f"""WITH {c.SQL_TIMED}
SELECT account_id, encounter_id, icd10_code, dx_name AS icd10_description, timing_category,
       CASE WHEN timing_category = 'BEFORE' THEN 'Available at encounter start'
            ELSE {second("event_ts")} END AS availability_time,
       {second("event_ts")} AS event_time, source
FROM timed WHERE timing_category <> 'AFTER'""",
)
def diagnosis_timing(t: Tables):
    rows = extract.diagnosis_timing(**c.diagnosis_sources(t))
    return rows.withColumn("event_time", F.date_format("event_ts", TS)).drop("event_ts")


@query(
    "poa_anchor",
    f"""WITH {c.SQL_DIAGNOSES}
SELECT account_id, poa_code, {second("event_ts")} AS first_dx_time
FROM (SELECT DISTINCT account_id, event_ts, poa_code FROM dx_rows
      WHERE source = 'INPATIENT_ACCT_DX' AND poa_code IS NOT NULL
        AND (icd10_code LIKE 'R%' OR lower(dx_name) LIKE '%anvil%'))
QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY event_ts, poa_code) = 1""",
)
def poa_anchor(t: Tables):
    rows = extract.diagnoses(**c.diagnosis_sources(t))
    found = extract.poa_anchor(rows, "icd10_code LIKE 'R%' OR lower(dx_name) LIKE '%anvil%'")
    return found.select(
        "account_id", "poa_code", F.date_format("first_dx_ts", TS).alias("first_dx_time")
    )


@query(
    "patient_header",
    """SELECT o_orderkey AS account_id, c_custkey AS patient_id, c_mktsegment AS mrn,
       left(c_name, 8) || ' ' || substr(c_name, 10) AS formatted_name,
       strftime(first_order, '%m/%d/%Y') AS formatted_birthdate,
       'Nation 7' AS facility_name,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE)) AS INTEGER)
         AS number_of_midnights,
       CAST(floor(date_diff('day', CAST(first_order AS DATE), CAST(last_ship AS DATE)) / 365.25)
         AS BIGINT) AS age_at_discharge,
       strftime(o_orderdate, '%m/%d/%Y') || '-' || strftime(last_ship, '%m/%d/%Y')
         AS formatted_date_of_service
FROM orders
JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1)
  ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey
JOIN (SELECT o_custkey AS k, min(o_orderdate) AS first_order FROM orders GROUP BY 1) ON k = c_custkey
""",
)
def patient_header(t: Tables):
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("discharge_ts"))
    accounts = t.orders.join(shipped, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("account_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("admit_ts"),
        "discharge_ts",
        F.lit("PARENT  NATION 7 ").alias("location"),
    )
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("birth_date"))
    patients = t.customer.join(first, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("patient_id"),
        F.col("c_mktsegment").alias("mrn"),
        F.left("c_name", F.lit(8)).alias("first_name"),
        F.substring("c_name", 10, 100).alias("last_name"),
        "birth_date",
    )
    return extract.patient_header(accounts, patients, extract.facility_of(F.col("location")))


# --- notes ------------------------------------------------------------------------------------


def note_rows(t: Tables):
    """Each turn is a note of its role; the turn orders them and dates the note."""
    return t.conversations.select(
        F.col("conv_id").alias("account_id"),
        F.col("role").alias("note_type"),
        F.col("turn").alias("note_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("note_csn_id"),
        F.timestamp_seconds(F.col("turn") * 3600).cast("date").alias("contact_date"),
        F.timestamp_seconds(F.col("turn") * 3600).alias("entry_ts"),
        F.col("text").alias("note_text"),
    )


ROLES = {"system": "system", "user": "user", "assistant": "assistant"}


@query(
    "note_lines_joined",
    """SELECT conv_id, role, 0 AS part_no, count(text) AS n_lines,
       string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id, role""",
)
def note_lines_joined(t: Tables):
    return notes.reassemble(t.conversations, ["conv_id", "role"], "text", "turn")


SQL_NOTES = """
typed AS (
  SELECT conv_id AS account_id, role AS note_type, count(text) AS n_notes,
         string_agg(CAST(turn AS VARCHAR), ', ' ORDER BY turn) AS note_ids,
         string_agg(CAST(conv_id * 100 + turn AS VARCHAR), ', ' ORDER BY turn) AS note_csn_ids,
         string_agg('[' || strftime(TIMESTAMP '1970-01-01' + to_hours(CAST(turn AS INTEGER)),
             '%Y-%m-%d %H:%M:%S') || ']' || chr(10) || text,
           chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS note_text
  FROM conversations GROUP BY conv_id, role
)"""


@query(
    "notes_by_type",
    f"WITH {SQL_NOTES} SELECT account_id, note_type, 0 AS part_no, n_notes, note_ids, "
    "note_csn_ids, note_text FROM typed",
)
def notes_by_type(t: Tables):
    return notes.notes_by_type(note_rows(t), types=tuple(ROLES))


def _sql_wide() -> str:
    columns = []
    for stem in ROLES:
        for suffix, column, default in (
            ("id", "note_ids", NO_ID),
            ("csn_id", "note_csn_ids", NO_ID),
            ("text", "note_text", NO_NOTE),
        ):
            columns.append(
                f"coalesce(max(CASE WHEN note_type = '{stem}' THEN {column} END), '{default}') "
                f"AS {stem}_{suffix}"
            )
    return (
        f"WITH {SQL_NOTES} SELECT account_id, 0 AS part_no, {', '.join(columns)} "
        "FROM typed GROUP BY account_id"
    )


@query("notes_wide", _sql_wide())
def notes_wide(t: Tables):
    by_type = notes.notes_by_type(note_rows(t), notes.wide_part_chars(ROLES), tuple(ROLES))
    return notes.notes_wide(by_type, ROLES)


@query(
    "latest_note_per_type",
    """SELECT conv_id AS account_id, role AS note_type, turn AS note_id, text AS note_text
FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1""",
)
def latest_note_per_type(t: Tables):
    return notes.latest_notes(note_rows(t)).select(
        "account_id", "note_type", "note_id", "note_text"
    )


@query(
    "notes_per_type",
    "SELECT conv_id AS account_id, role AS note_type, count(*) AS n_notes "
    "FROM conversations GROUP BY 1, 2",
)
def notes_per_type(t: Tables):
    return notes.notes_per_type(note_rows(t))


KEYS = {"assistant": "discharge_summary", "user": "nursing_note", "system": "zz_other"}


def extracted(t: Tables):
    key = F.create_map(*[F.lit(x) for pair in KEYS.items() for x in pair])
    latest = notes.latest_notes(note_rows(t))
    text = F.when(F.length("note_text") >= 40, F.col("note_text"))
    return latest.select(
        "account_id",
        F.try_element_at(key, F.col("note_type")).alias("note_key"),
        notes.gate(text).alias("note_text"),
    )


SQL_EXTRACTED = """
extracted AS (
  SELECT conv_id AS account_id,
         CASE role WHEN 'assistant' THEN 'discharge_summary' WHEN 'user' THEN 'nursing_note'
           WHEN 'system' THEN 'zz_other' END AS note_key,
         CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 8 ELSE 9 END AS priority,
         CASE role WHEN 'assistant' THEN 'Discharge Summary' WHEN 'user' THEN 'Nursing Note'
           ELSE 'Zz Other' END AS title,
         CASE WHEN length(text) >= 40 THEN text ELSE 'Not available' END AS note_text
  FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1
)"""


@query(
    "notes_summary",
    f"""WITH {SQL_EXTRACTED}
SELECT account_id, CAST(0 AS INTEGER) AS part_no, string_agg('## ' || note_key || chr(10) || note_text,
       chr(10) || chr(10) ORDER BY note_key) AS notes_summary
FROM extracted WHERE note_text <> 'Not available' GROUP BY account_id""",
)
def notes_summary(t: Tables):
    return notes.notes_summary(extracted(t))


@query(
    "note_priority_context",
    f"""WITH {SQL_EXTRACTED}
SELECT account_id, CAST(0 AS INTEGER) AS part_no,
       count(CASE WHEN note_text <> 'Not available' THEN 1 END) AS n_notes,
       coalesce(string_agg('## ' || title || chr(10) || note_text, chr(10) || chr(10)
         ORDER BY priority, note_key) FILTER (WHERE note_text <> 'Not available'),
         'No clinical notes available.') AS notes_section
FROM extracted GROUP BY account_id""",
)
def note_priority_context(t: Tables):
    return notes.notes_section(extracted(t))


@query(
    "note_gate",
    """SELECT doc_id,
       CASE WHEN coalesce(text, '') = '' THEN 'Not available'
            WHEN quality = 1 THEN 'extracted ' || doc_id ELSE text END AS note_text
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def note_gate(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    done = F.when(
        F.col("quality") == 1, F.concat(F.lit("extracted "), F.col("doc_id").cast("string"))
    )
    return rows.select(
        "doc_id", notes.gate(F.col("text"), done).alias("note_text")
    )
