"""Front filter, orders for readers, file names and listings, the insert read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseflow.functions.text import character_overlap, safe_file_name
from caseflow.operators import extract, quality, timeline
from caseflow.session import checkpoint_dir
from caseflow.sources.documents import new_files
from caseflow.sources.sinks import insert_unseen_files
from standins import clinical as c
from standins.registry import Tables, query, second
from standins.timeline_queries import TS, merged, vitals_rows


@query(
    "target_encounters",
    f"""SELECT o_custkey AS account_id, o_orderkey AS encounter_id, o_custkey AS patient_id,
  {second("o_orderdate")} AS start_time
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def target_encounters(t: Tables):
    """The encounters of the cases at hand; a case named twice counts once."""
    encounters = t.orders.select(
        F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("encounter_id"),
        F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("start_ts"),
        F.lit(None).cast("timestamp").alias("end_ts"),
    )
    cases = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("account_id"))
    rows = extract.target_encounters(encounters, cases.unionByName(cases))
    return rows.select("account_id", "encounter_id", "patient_id", F.date_format("start_ts", TS).alias("start_time"))


@query(
    "vitals_of_cases",
    f"""SELECT user_id AS account_id, user_id AS encounter_id, {second("ts")} AS event_time,
       event_type AS vital_name, CAST(value AS VARCHAR) AS vital_value
FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 1
  AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def vitals_of_cases(t: Tables):
    enc = t.customer.select(
        F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("encounter_id"),
        F.col("c_custkey").alias("patient_id"), F.lit(None).cast("timestamp").alias("start_ts"),
        F.lit(None).cast("timestamp").alias("end_ts"),
    )
    cases = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("account_id"))
    return vitals_rows(t, extract.target_encounters(enc, cases))


@query(
    "timings_in_order",
    f"""WITH {c.SQL_TIMED}
SELECT account_id, encounter_id, icd10_code, timing_category, {second("event_ts")} AS event_time, source
FROM timed WHERE timing_category <> 'AFTER'
ORDER BY account_id, timing_category DESC, event_ts, icd10_code""",
)
def timings_in_order(t: Tables):
    rows = extract.timings_in_order(extract.diagnosis_timing(**c.diagnosis_sources(t)))
    return rows.select(
        "account_id", "encounter_id", "icd10_code", "timing_category",
        F.date_format("event_ts", TS).alias("event_time"), "source",
    )


@query(
    "character_overlap",
    """WITH n AS (
  SELECT doc_id, length(text) AS size,
         lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS t FROM documents
)
SELECT a.doc_id,
  CASE WHEN a.size = 0 OR b.size = 0 THEN 0.0 WHEN contains(a.t, b.t) OR contains(b.t, a.t) THEN 1.0
  ELSE CAST(len(list_filter(list_zip(string_split(a.t, ''), string_split(b.t, '')),
         lambda x: x[1] = x[2])) AS DOUBLE) / least(length(a.t), length(b.t)) END AS overlap
FROM n a JOIN n b ON b.doc_id = a.doc_id + 1""",
)
def overlaps(t: Tables):
    """Each document against the next by id."""
    other = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    rows = t.documents.join(other, "doc_id")
    return rows.select("doc_id", character_overlap(F.col("text"), F.col("other")).alias("overlap"))


@query(
    "safe_file_names",
    r"""SELECT doc_id, trim(regexp_replace(text, '[^\p{L}\p{N} _-]', '', 'g')) AS file_name FROM documents""",
)
def safe_file_names(t: Tables):
    return t.documents.select("doc_id", safe_file_name(F.col("text")).alias("file_name"))


def _files(t: Tables):
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), F.upper("lang"))
    return t.documents.select(F.concat(F.lit("/in/"), name).alias("path"), name.alias("file_name"), "doc_id")


@query(
    "files_by_extension",
    "SELECT lower(lang) AS extension, count(*) AS n_files FROM documents GROUP BY 1",
)
def files_by_extension(t: Tables):
    return quality.files_by_extension(_files(t))


@query(
    "files_not_loaded",
    """SELECT source || '_' || doc_id || '.' || upper(lang) AS file_name FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def files_not_loaded(t: Tables):
    files = _files(t)
    loaded = files.join(t.labels, "doc_id", "left_semi")
    return new_files(files, loaded).select("file_name")


@query(
    "insert_read_back",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT l_orderkey, l_linenumber, min(l_partkey) FROM lineitem a
WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R'
  AND b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber)
GROUP BY 1, 2""",
)
def insert_read_back(t: Tables):
    """Rows are inserted where their key is new: copies inside the batch and a second run add nothing."""
    keys, columns = ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber", "l_partkey")
    path = f"{checkpoint_dir(t.spark)}/inserted/{uuid.uuid4().hex}"
    t.lineitem.filter("l_returnflag = 'R'").select(*columns).write.parquet(path)
    more = t.lineitem.select(*columns)
    more = more.unionByName(more.withColumn("l_partkey", F.col("l_partkey") + 1))
    for _ in range(2):
        insert_unseen_files(more, path, keys)
    return t.spark.read.parquet(path)


@query(
    "sections_in_order",
    f"""WITH {c.SQL_TIMELINE}
SELECT account_id, 'TIMELINE_EVENT' AS section_type, {second("event_ts")} AS event_time
FROM timeline""",
)
def sections_in_order(t: Tables):
    rows = merged(t).select(
        "account_id", F.lit("TIMELINE_EVENT").alias("section_type"), F.lit(2).alias("sort_order"),
        "event_ts", F.col("event_detail").alias("content"),
    )
    return timeline.sections_in_order(rows).select(
        "account_id", "section_type", F.date_format("event_ts", TS).alias("event_time")
    )


