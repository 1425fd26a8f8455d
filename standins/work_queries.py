"""Workqueue, incremental work, case tables, status and quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseflow.functions.times import DAY, micros
from caseflow.operators import extract, notes, quality, report
from caseflow.plans import case, spine, workqueue
from caseflow.profiles import SEPSIS
from caseflow.operators.textparts import by_part, json_parts
from caseflow.session import checkpoint_dir
from caseflow.sources.sinks import replace_slice, staged, unseen
from caseflow.streaming.incremental import to_score, unprocessed_letters
from standins.registry import Tables, query
from standins.timeline_queries import extracted

AS_OF = "1999-06-30"
CLASSES = {"Medicare": (1, 2), "Commercial": (3, 4)}


@query(
    "workqueue_population",
    f"""SELECT o_orderkey AS entry_id, o_custkey AS account_id,
  strftime(o_orderdate, '%Y-%m-%d') AS entry_date,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'Medicare' ELSE 'Commercial' END AS letter_type
FROM orders
WHERE o_orderpriority[1] IN ('1', '2', '3', '4')
  AND CAST(o_orderdate AS DATE) <= DATE '{AS_OF}' - 5
  AND (CAST(o_orderdate AS DATE) > (SELECT coalesce(max(CAST(o_orderdate AS DATE)),
         DATE '2025-07-01') FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < DATE '1997-01-01')
    OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))""",
)
def workqueue_population(t: Tables):
    o = t.orders
    day = F.to_date("o_orderdate")
    queue = o.select(
        F.col("o_orderkey").alias("entry_id"),
        F.col("o_custkey").alias("account_id"),
        day.alias("entry_date"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("financial_class"),
    )
    scored = o.filter("o_orderstatus = 'F' and o_orderdate < '1997-01-01'").select(
        day.alias("entry_date")
    )
    # a null among the processed accounts must not hide the others
    processed = o.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("account_id")
    )
    rows = workqueue.population(queue, scored, processed, F.to_date(F.lit(AS_OF)), CLASSES)
    return rows.select(
        "entry_id", "account_id", F.date_format("entry_date", "yyyy-MM-dd").alias("entry_date"),
        "letter_type",
    )


@query(
    "workqueue_in_order",
    """SELECT o_custkey AS account_id, strftime(o_orderdate, '%Y-%m-%d') AS entry_date, o_orderkey AS entry_id,
  'order' AS queue, NULL AS line_status
FROM orders WHERE o_orderpriority[1] = '1'
UNION ALL
SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d'), l_partkey, 'line', l_linestatus
FROM lineitem WHERE l_quantity > 45
ORDER BY entry_date, account_id, entry_id""",
)
def workqueue_in_order(t: Tables):
    orders = t.orders.filter(F.left("o_orderpriority", F.lit(1)) == "1").select(
        F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("entry_date"),
        F.col("o_orderkey").alias("entry_id"), F.lit("order").alias("queue"),
    )
    lines = t.lineitem.filter("l_quantity > 45").select(
        F.col("l_orderkey").alias("account_id"), F.to_date("l_shipdate").alias("entry_date"),
        F.col("l_partkey").alias("entry_id"), F.lit("line").alias("queue"), F.col("l_linestatus").alias("line_status"),
    )
    return workqueue.in_order(orders, lines).withColumn("entry_date", F.date_format("entry_date", "yyyy-MM-dd"))


def claim_rows(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("account_id"),
        F.col("l_suppkey").alias("tax_id"),
        F.col("l_partkey").alias("npi"),
        F.col("l_returnflag").alias("icn"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("icn_no"),
        F.when(F.col("l_quantity") > 10, F.col("l_linenumber").cast("string")).alias("control_no"),
        "l_linenumber",
    )


@query(
    "claim_rollup",
    """SELECT l_orderkey AS account_id, max(l_suppkey) AS tax_id, max(l_partkey) AS npi,
  count(*) AS n_claims,
  concat_ws(', ', min(l_returnflag), CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') > 0
    THEN 'O' END, CAST(min(l_linenumber) FILTER (WHERE l_quantity > 10) AS VARCHAR))
    AS all_claim_ids
FROM lineitem GROUP BY l_orderkey""",
)
def claim_rollup(t: Tables):
    return extract.claim_rollup(claim_rows(t))


@query(
    "claim_id_lists",
    """WITH ids AS (
  SELECT l_orderkey AS account_id, l_linenumber, unnest([
    {'id_kind': 'icn', 'v': l_returnflag},
    {'id_kind': 'icn_no', 'v': CASE WHEN l_linestatus = 'O' THEN 'O' END},
    {'id_kind': 'control_no', 'v': CASE WHEN l_quantity > 10 THEN CAST(l_linenumber AS VARCHAR) END}
  ]) AS c FROM lineitem
)
SELECT account_id, c.id_kind AS id_kind, 0 AS part_no, count(*) AS n_rows,
  string_agg(c.v, ', ' ORDER BY l_linenumber, c.v) AS claim_ids
FROM ids WHERE c.v IS NOT NULL GROUP BY 1, 2""",
)
def claim_id_lists(t: Tables):
    return extract.claim_id_lists(claim_rows(t), F.col("l_linenumber").cast("long"), 1)


KINDS = ("Payor", "Plans", "Payor or plan", "Payor and Location?")


@query(
    "address_mapping",
    """WITH rules AS (
  SELECT CASE n_nationkey % 4 WHEN 0 THEN 'Payor' WHEN 1 THEN 'Plans' WHEN 2 THEN 'Payor or plan'
    ELSE 'Payor and Location?' END AS map_to, n_nationkey % 4 AS rule,
    n_regionkey + CASE WHEN n_nationkey < 12 THEN 0 ELSE 2 END AS mapped_payor_id,
    n_nationkey AS mapped_plan_id, n_name AS payor_address FROM nation
),
accounts AS (
  SELECT DISTINCT c_custkey AS account_id, c_mktsegment AS npi, n_regionkey + 4 AS payor_id,
    c_nationkey AS plan_id FROM customer JOIN nation ON n_nationkey = c_nationkey
)
SELECT account_id, npi, payor_id, plan_id, payor_address AS mapped_address
FROM accounts LEFT JOIN rules ON
     (map_to = 'Payor' AND (payor_id = mapped_payor_id OR plan_id = mapped_plan_id))
  OR (map_to = 'Plans' AND plan_id = mapped_plan_id)
  OR (map_to = 'Payor or plan' AND (plan_id = mapped_plan_id OR payor_id = mapped_payor_id))
  OR (map_to = 'Payor and Location?' AND npi IN ('BUILDING', 'FURNITURE')
      AND payor_id = mapped_payor_id)
QUALIFY row_number() OVER (PARTITION BY account_id, npi
  ORDER BY payor_id, plan_id, rule, payor_address) = 1""",
)
def address_mapping(t: Tables):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    n = t.nation
    rules = n.select(
        F.element_at(kinds, F.col("n_nationkey") % 4 + 1).alias("map_to"),
        (F.col("n_regionkey") + F.when(F.col("n_nationkey") < 12, 0).otherwise(2)).alias(
            "mapped_payor_id"
        ),
        F.col("n_nationkey").alias("mapped_plan_id"),
        F.col("n_name").alias("payor_address"),
    )
    accounts = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_mktsegment").alias("npi"),
        (F.col("n_regionkey") + 4).alias("payor_id"),
        F.col("c_nationkey").alias("plan_id"),
    )
    return workqueue.mapped_addresses(accounts, rules, ("BUILDING", "FURNITURE"))


def _sql_transition(day2: bool) -> str:
    kept = "bool_or(s) AND bool_or(p)" if day2 else "bool_or(s)"
    return f"""WITH arrival AS (
  SELECT user_id, CAST(min(ts) AS DATE) AS day1 FROM events GROUP BY user_id
),
days AS (
  SELECT user_id, day1, event_type = 'signup' AND CAST(ts AS DATE) = day1 AS s,
    event_type = 'purchase' AND CAST(ts AS DATE) = day1 + 1 AS p
  FROM events JOIN arrival USING (user_id)
)
SELECT user_id AS encounter_id, user_id AS account_id,
  strftime(any_value(day1), '%Y-%m-%d') AS day1_arrival_date,
  strftime(any_value(day1) + 1, '%Y-%m-%d') AS day2_ip_date
FROM days GROUP BY user_id HAVING {kept}"""


def _transition(t: Tables, day2: bool):
    e = t.events.select(
        F.col("user_id").alias("patient_id"),
        F.col("user_id").alias("encounter_id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").alias("event_ts"),
        "event_type",
    )
    kind = F.col("event_type")
    rows = workqueue.observation_to_inpatient(e, kind == "signup", kind == "purchase", day2)
    return rows.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("day1_arrival_date", "day2_ip_date")}
    )


@query("obs_to_inpatient", _sql_transition(False))
def obs_to_inpatient(t: Tables):
    return _transition(t, False)


@query("obs_to_inpatient_day2", _sql_transition(True))
def obs_to_inpatient_day2(t: Tables):
    return _transition(t, True)


@query(
    "events_within_span",
    """SELECT l_orderkey, l_linenumber, l_shipmonth, count(*) AS n FROM (
  SELECT *, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem
  WHERE l_shipdate BETWEEN (SELECT min(o_orderdate) FROM orders WHERE o_orderpriority = '1-URGENT')
    AND (SELECT max(o_orderdate) FROM orders WHERE o_orderpriority = '1-URGENT'))
GROUP BY ALL""",
)
def events_within_span(t: Tables):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    rows = workqueue.within_span(t.lineitem, "l_shipdate", urgent, "o_orderdate")
    return rows.groupBy(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth")
    ).agg(F.count("*").alias("n"))


@query(
    "principal_line",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber = 1",
)
def principal_line(t: Tables):
    return extract.principal_line(t.lineitem, "l_linenumber").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"
    )


@query(
    "spine_features",
    """WITH latest AS (
  SELECT o_custkey, o_orderkey, o_orderdate FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
),
claims AS (
  SELECT o_custkey, arg_min(l_suppkey, l_orderkey * 100000 + l_partkey) AS tax_id,
         min(l_orderkey * 100000 + l_partkey) AS k
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
)
SELECT c_custkey AS account_id, o_orderkey AS encounter_id,
  strftime(o_orderdate, '%m/%d/%Y') AS admitted, n_name AS facility_name, k AS claim_key,
  note AS note_text, 0 AS part_no
FROM customer LEFT JOIN latest ON latest.o_custkey = c_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN claims ON claims.o_custkey = c_custkey
LEFT JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS note FROM conversations
           GROUP BY 1) ON conv_id = c_custkey""",
)
def spine_features(t: Tables):
    from caseflow.operators.notes import reassemble

    encounters = t.orders.select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderkey").alias("encounter_id"),
        F.col("o_orderdate").alias("admit_ts"),
    )
    latest = spine.latest_encounters(encounters).select(
        "account_id", "encounter_id", F.date_format("admit_ts", "MM/dd/yyyy").alias("admitted")
    )
    facility = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").alias("account_id"), F.col("n_name").alias("facility_name")
    )
    claims = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("account_id"),
        (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("claim_key"),
    )
    first = spine.first_claims(claims, "claim_key", ("claim_key",))
    turns = t.conversations.select(F.col("conv_id").alias("account_id"), "turn", "text")
    texts = reassemble(turns, ["account_id"], "text", "turn", " ").drop("n_lines")
    texts = texts.withColumnRenamed("text", "note_text")
    accounts = t.customer.select(F.col("c_custkey").alias("account_id"))
    return spine.spine_features(accounts, latest, facility, first, texts)


# --- incremental ------------------------------------------------------------------------------


@query(
    "incremental_unscored",
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders
                     WHERE o_orderstatus = 'F' AND o_orderdate < DATE '2001-01-01')
   OR o_custkey NOT IN (SELECT o_custkey FROM orders
                        WHERE o_orderstatus = 'F' AND o_orderdate < DATE '2001-01-01')""",
)
def incremental_unscored(t: Tables):
    scored = t.orders.filter("o_orderstatus = 'F' and o_orderdate < '2001-01-01'")
    rows = to_score(
        t.orders, scored, F.to_timestamp(F.lit("2025-07-01")), "o_custkey", "o_orderdate"
    )
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "unprocessed_letters",
    """SELECT doc_id AS letter_id, length(text) AS n,
  CASE WHEN length(text) <= 100 THEN 'Insufficient text (' || length(text) || ' chars)' END AS skip_reason
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def unprocessed(t: Tables):
    letters = t.documents.select(
        F.col("doc_id").alias("letter_id"), F.col("text").alias("letter_text")
    )
    done = t.labels.select(F.col("doc_id").alias("letter_id"))
    return unprocessed_letters(letters, done).select(
        "letter_id", F.length("letter_text").cast("long").alias("n"), "skip_reason"
    )


@query(
    "insert_unseen",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R'
  AND b.l_orderkey = lineitem.l_orderkey AND b.l_linenumber = lineitem.l_linenumber)""",
)
def insert_unseen(t: Tables):
    target = t.lineitem.filter("l_returnflag = 'R'")
    return unseen(t.lineitem, target, ("l_orderkey", "l_linenumber")).select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


# --- case tables ------------------------------------------------------------------------------


def read_back(t: Tables):
    c, o = t.customer, t.orders
    account = F.col("c_custkey").alias("account_id")
    denial = c.select(
        account,
        F.col("c_name").alias("denial_text"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("payor"),
        F.lit("870").alias("original_drg"),
        F.lit(None).cast("string").alias("proposed_drg"),
        F.when(F.col("c_acctbal") > 0, F.lit(True)).alias("is_condition_match"),
    )
    clinical = c.filter("c_acctbal > 1000").select(
        account,
        F.col("c_name").alias("patient_name"),
        F.lit("01/01/1950").alias("patient_dob"),
        F.lit(None).cast("string").alias("facility_name"),
        F.lit("01/01/2024").alias("date_of_service"),
    )
    summary = o.groupBy(F.col("o_custkey").alias("account_id")).agg(
        F.concat(F.lit("orders "), F.count("*").cast("string")).alias("structured_summary")
    )
    scores = (
        o.filter("o_orderstatus = 'F'")
        .groupBy(F.col("o_custkey").alias("account_id"))
        .agg(
            F.count("*").cast("int").alias("total_score"),
            F.max(F.left("o_orderpriority", F.lit(1)).cast("int")).alias("organs_scored"),
        )
    )
    conflicts = c.filter("c_nationkey > 12").select(
        account,
        F.array("c_mktsegment", "c_name").alias("conflicts"),
        F.lit(None).cast("string").alias("recommendation"),
    )
    return case.read_back(denial, clinical, summary, scores, conflicts, "General Hospital")


SQL_CASES = """
cases AS (
  SELECT c_custkey AS account_id, c_name AS denial_text,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'Unknown' END AS payor,
    '870' AS original_drg, CAST(NULL AS VARCHAR) AS proposed_drg, c_acctbal > 0 AS is_condition_match,
    CASE WHEN c_acctbal > 1000 THEN c_name ELSE 'Unknown' END AS patient_name,
    CASE WHEN c_acctbal > 1000 THEN '01/01/1950' ELSE '' END AS patient_dob,
    'General Hospital' AS facility_name,
    CASE WHEN c_acctbal > 1000 THEN '01/01/2024' ELSE '' END AS date_of_service,
    coalesce('orders ' || n, 'No structured data available.') AS structured_summary,
    CAST(nullif(nf, 0) AS INTEGER) AS total_score, organs AS organs_scored,
    CASE WHEN c_nationkey > 12 THEN c_mktsegment || '/' || c_name ELSE '' END AS conflicts,
    CASE WHEN c_nationkey > 12 THEN 2 ELSE 0 END AS n_conflicts,
    '' AS recommendation
  FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS nf,
      max(CAST(o_orderpriority[1] AS INTEGER)) FILTER (WHERE o_orderstatus = 'F') AS organs
    FROM orders GROUP BY 1) ON o_custkey = c_custkey
)"""


@query(
    "case_readback",
    f"""WITH {SQL_CASES} SELECT * EXCLUDE (n_conflicts) REPLACE (
  CAST(total_score AS DOUBLE) AS total_score, CAST(organs_scored AS DOUBLE) AS organs_scored),
  0 AS part_no
FROM cases""",
)
def case_readback(t: Tables):
    scores = {c: F.col(c).cast("double") for c in ("total_score", "organs_scored")}
    return read_back(t).withColumns({"conflicts": F.array_join("conflicts", "/"), **scores})


@query(
    "case_summary",
    f"""WITH {SQL_CASES}
SELECT account_id, patient_name, coalesce(n, 0) AS n_notes,
  CAST(length(structured_summary) AS BIGINT) AS summary_chars,
  coalesce(total_score, 0) AS total_score, coalesce(organs_scored, 0) AS organs_scored, n_conflicts
FROM cases LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
  ON conv_id = account_id""",
)
def case_summary(t: Tables):
    counts = t.conversations.groupBy(F.col("conv_id").alias("account_id")).agg(
        F.count("*").alias("n_notes")
    )
    return case.case_summary(read_back(t), counts)


TEMPLATE = (
    "Patient {patient_name}, account {hsp_account_id}, payor {payor}, DRG {original_drg} to "
    "{proposed_drg}.\n{denial_letter_text}\n{structured_data_summary}\n{clinical_scores_section}\n"
    "{clinical_definition_section}\n{gold_letter_section}\n{clinical_notes_section}\n"
    "{conditional_rebuttals_section}"
)


@query(
    "writer_context",
    f"""WITH {SQL_CASES}
SELECT account_id, 0 AS part_no, 'Patient ' || patient_name || ', account ' || account_id || ', payor ' || payor
  || ', DRG 870 to Unknown.' || chr(10) || denial_text || ' {{payor}}' || chr(10)
  || structured_summary || chr(10) || coalesce('score ' || total_score,
     'Clinical scores not available.') || chr(10)
  || CASE WHEN account_id % 2 = 0 THEN '## OFFICIAL SEPSIS DEFINITION' || chr(10) || 'two'
     ELSE 'No specific definition loaded.' END || chr(10)
  || CASE WHEN account_id % 3 = 0 THEN 'letter ' || account_id ELSE '' END || chr(10)
  || coalesce(notes_section, 'No clinical notes available.') || chr(10) || coalesce(rebuttals, '') AS prompt
FROM cases LEFT JOIN (
  SELECT account_id, coalesce(string_agg('## ' || title || chr(10) || note_text, chr(10) || chr(10)
    ORDER BY priority, note_key) FILTER (WHERE note_text <> 'Not available'),
    'No clinical notes available.') AS notes_section
  FROM (SELECT conv_id AS account_id,
      CASE role WHEN 'assistant' THEN 'discharge_summary' WHEN 'user' THEN 'nursing_note' ELSE 'zz_other' END AS note_key,
      CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 8 ELSE 9 END AS priority,
      CASE role WHEN 'assistant' THEN 'Discharge Summary' WHEN 'user' THEN 'Nursing Note' ELSE 'Zz Other' END AS title,
      CASE WHEN length(text) >= 40 THEN text ELSE 'Not available' END AS note_text
    FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1)
  GROUP BY account_id) USING (account_id)
LEFT JOIN (
  SELECT o_custkey AS account_id, string_agg('## ' || o_orderpriority || chr(10) || n || ' orders',
    chr(10) || chr(10) ORDER BY o_orderpriority) AS rebuttals
  FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)
  USING (account_id)""",
)
def writer_context(t: Tables):
    even = F.col("account_id") % 2 == 0
    cases = read_back(t).select(
        "*",
        F.concat(F.lit("score "), F.col("total_score").cast("string")).alias("scores_text"),
        F.when(even, "two").alias("definition"),
        F.when(
            F.col("account_id") % 3 == 0, F.concat(F.lit("letter "), F.col("account_id").cast("string"))
        ).otherwise("").alias("template_letter"),
    )
    # a value that looks like a placeholder stays as it is
    cases = cases.withColumn("denial_text", F.concat("denial_text", F.lit(" {payor}")))
    section = notes.notes_section(extracted(t)).drop("n_notes")
    counts = t.orders.groupBy(F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("name"))
    rebuttals = counts.agg(F.concat(F.count("*").cast("string"), F.lit(" orders")).alias("text"))
    return report.writer_context(by_part(cases, (section,), "account_id"), TEMPLATE, SEPSIS, rebuttals)


SQL_STATUS = """
cases AS (
  SELECT doc_id, CASE WHEN length(text) < 50 THEN 'JSON parse failed' END AS parse_error,
    quality, CASE WHEN toxic = 1 THEN 'writer failed' END AS generation_error,
    CASE WHEN lang = 'en' THEN '871' ELSE '999' END AS drg
  FROM documents LEFT JOIN labels USING (doc_id)
),
decided AS (
  SELECT doc_id, CASE WHEN parse_error IS NOT NULL THEN 'parse_error'
      WHEN coalesce(quality, 0) <> 1 THEN 'out_of_scope'
      WHEN generation_error IS NOT NULL THEN 'generation_error' ELSE 'success' END AS status,
    CASE WHEN parse_error IS NOT NULL THEN parse_error
      WHEN coalesce(quality, 0) <> 1 THEN 'Denial is not in scope'
      ELSE generation_error END AS reason,
    CASE WHEN drg = '999' THEN 'original_drg ''999'' not in expected codes' END AS drg_warning
  FROM cases
)"""


def decided(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    status, reason = report.case_status(
        F.when(F.length("text") < 50, "JSON parse failed"),
        F.col("quality") == 1,
        F.when(F.col("toxic") == 1, "writer failed"),
    )
    drg = F.when(F.col("lang") == "en", "871").otherwise("999")
    return rows.select(
        "doc_id",
        status.alias("status"),
        reason.alias("reason"),
        report.drg_warning(drg, SEPSIS.drg_codes).alias("drg_warning"),
    )


@query("case_status", f"WITH {SQL_STATUS} SELECT * FROM decided")
def case_status(t: Tables):
    return decided(t)


@query(
    "status_tally",
    f"WITH {SQL_STATUS} SELECT status, count(*) AS n_cases FROM decided GROUP BY status",
)
def status_tally(t: Tables):
    return report.status_tally(decided(t))


@query(
    "records_json",
    """SELECT o_custkey AS account_id, 0 AS part_no, count(*) AS n_rows,
  '[' || string_agg('{"data_type":"' || o_orderstatus || '","name":"' || o_orderpriority || '"}',
    ',' ORDER BY o_orderdate, o_orderkey) || ']' AS records
FROM orders GROUP BY o_custkey""",
)
def records_json(t: Tables):
    record = F.struct(
        F.col("o_orderstatus").alias("data_type"), F.col("o_orderpriority").alias("name")
    )
    orders = t.orders.withColumnRenamed("o_custkey", "account_id")
    return json_parts(
        orders, ["account_id"], record, micros(F.col("o_orderdate")), [F.col("o_orderkey")],
        width=30 * DAY,
    )


@query(
    "kb_replace_slice",
    """SELECT lang AS condition_name, source || '_' || doc_id AS source_file, text AS letter_text,
  1 AS version FROM documents WHERE lang <> 'de'
UNION ALL
SELECT 'de', source || '_' || doc_id, text || ' again', 2 FROM documents WHERE lang = 'de'""",
)
def kb_replace_slice(t: Tables):
    """All letters are written by condition; then one condition is ingested anew."""
    first = t.documents.select(
        F.col("lang").alias("condition_name"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("source_file"),
        F.col("text").alias("letter_text"),
        F.lit(1).alias("version"),
    )
    path = f"{checkpoint_dir(t.spark)}/library/{uuid.uuid4().hex}"
    replace_slice(first, path, "condition_name")
    again = first.filter("condition_name = 'de'")
    changed = F.concat("letter_text", F.lit(" again"))
    replace_slice(
        again.withColumns({"letter_text": changed, "version": F.lit(2)}),
        path,
        "condition_name",
    )
    return t.spark.read.schema(first.schema).parquet(path)


# --- quality ----------------------------------------------------------------------------------


def documents_labelled(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left")


@query(
    "fill_audit",
    """SELECT count(*) AS total_rows, count(text) AS has_text, count(quality) AS has_quality,
  count(toxic) AS has_toxic, count(CASE WHEN quality = 1 THEN 1 END) AS good_count
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def fill_audit(t: Tables):
    return quality.fill_counts(
        documents_labelled(t),
        {"has_text": "text", "has_quality": "quality", "has_toxic": "toxic"},
        {"good_count": F.col("quality") == 1},
    )


@query(
    "null_audit",
    """SELECT doc_id, CASE WHEN text IS NULL THEN 'NULL' ELSE 'OK' END AS text,
  CASE WHEN quality IS NULL THEN 'NULL' ELSE 'OK' END AS quality
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def null_audit(t: Tables):
    return quality.null_labels(documents_labelled(t), "doc_id", ("text", "quality"))


@query(
    "missing_audit",
    """SELECT doc_id, CASE WHEN length(text) < 200 THEN 'MISSING' ELSE 'OK' END AS note,
  CASE WHEN quality IS NULL THEN 'MISSING' ELSE 'OK' END AS label
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def missing_audit(t: Tables):
    rows = documents_labelled(t).select(
        "doc_id",
        F.when(F.length("text") < 200, "No Note Available").otherwise(F.col("text")).alias("note"),
        F.col("quality").cast("string").alias("label"),
    )
    return quality.missing_labels(rows, "doc_id", ("note", "label"))


@query(
    "length_profile",
    """SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS text_chars,
  CAST(len(embedding) AS DOUBLE) AS embedding_dims
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
)
def length_profile(t: Tables):
    rows = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left")
    return quality.lengths(
        rows, ("doc_id", "lang"), {"text_chars": "text"}, {"embedding_dims": "embedding"}
    ).withColumn("embedding_dims", F.col("embedding_dims").cast("double"))


@query(
    "preview",
    "SELECT doc_id, left(text, 200) AS text_preview FROM documents ORDER BY doc_id LIMIT 3",
)
def preview(t: Tables):
    return quality.preview(t.documents, ("doc_id",), ("text",))


@query(
    "embedding_audit",
    """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first_val, CAST(embedding[64] AS DOUBLE)
  AS last_val FROM embeddings WHERE embedding IS NOT NULL""",
)
def embedding_audit(t: Tables):
    rows = quality.vector_ends(t.embeddings, ("vec_id",), "embedding", 64)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("first_val", "last_val")})


@query(
    "group_counts",
    "SELECT lang AS condition_name, count(*) AS letter_count FROM documents GROUP BY lang",
)
def group_counts(t: Tables):
    rows = t.documents.withColumnRenamed("lang", "condition_name")
    return quality.counts_by(rows, "condition_name", "letter_count")


@query(
    "payor_union",
    """SELECT 'cases' AS source, c_mktsegment AS payor, count(*) AS count FROM customer GROUP BY 2
UNION ALL SELECT 'orders', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def payor_union(t: Tables):
    return quality.labelled_counts(
        {
            "cases": t.customer.select(F.col("c_mktsegment").alias("payor")),
            "orders": t.orders.select(F.col("o_orderpriority").alias("payor")),
        },
        "payor",
    )


@query(
    "table_counts",
    """SELECT (SELECT count(*) FROM documents) AS letters, (SELECT count(*) FROM orders) AS cases,
  (SELECT count(*) FROM events) AS events""",
)
def table_counts(t: Tables):
    return quality.table_counts(
        t.spark, {"letters": t.documents, "cases": t.orders, "events": t.events}
    )


def checks(t: Tables):
    return quality.all_checks(
        quality.check_table(t.documents, "documents", ("doc_id", "text", "payor"), 1),
        quality.check_table(t.orders, "orders", ("o_orderkey",), 1),
        quality.check_table(t.labels, "labels", ("doc_id",), 1_000_000_000),
    )


SQL_CHECKS = """
checks AS (
  SELECT 'documents' AS check_name, count(*) AS n_rows, 'payor' AS missing_columns, false AS passed
  FROM documents
  UNION ALL SELECT 'orders', count(*), '', count(*) >= 1 FROM orders
  UNION ALL SELECT 'labels', count(*), '', count(*) >= 1000000000 FROM labels
)"""


@query("checks_at_the_sink", f"WITH {SQL_CHECKS} SELECT * FROM checks")
def checks_at_the_sink(t: Tables):
    """The same checks, made while the tables are written."""
    found = []
    for name, rows, expected, least in (
        ("documents", t.documents, ("doc_id", "text", "payor"), 1),
        ("orders", t.orders, ("o_orderkey",), 1),
        ("labels", t.labels, ("doc_id",), 1_000_000_000),
    ):
        rows, seen = quality.watched(rows)
        staged(rows)
        found.append(quality.check_watched(rows, seen, name, expected, least))
    return quality.all_checks(*found)


@query("checkpoint_report", f"WITH {SQL_CHECKS} SELECT * FROM checks")
def checkpoint_report(t: Tables):
    return checks(t)


@query(
    "checkpoint_summary",
    f"""WITH {SQL_CHECKS} SELECT count(*) FILTER (WHERE passed) AS n_passed, count(*) AS n_checks,
  bool_and(passed) AS all_passed FROM checks""",
)
def checkpoint_summary(t: Tables):
    return quality.check_summary(checks(t))
