"""Letters, replies about them, similarity and guidelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions.text import STOP_WORDS
from caseflow.functions.values import rating
from caseflow.operators import crosscheck, guidelines, letters, report, similarity
from caseflow.profiles import SEPSIS
from caseflow.sources.sinks import staged
from standins.registry import Tables, query

# Names that the stand-in documents do mention stand for payors and subject lines.
PAYORS = (("schber", "Alpha Health"), ("eaueux", "Beta Care"), ("thand", "Gamma Plan"))
PHRASES = ("the in", "dans le")
PAGE_LINES = 20


def pages(t: Tables):
    return letters.pages_of(t.documents.select("doc_id", "text"), PAGE_LINES)


SQL_PAGES = f"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
),
pages AS (
  SELECT doc_id, CAST((line_no - 1) // {PAGE_LINES} + 1 AS INTEGER) AS page_no,
         string_agg(line, chr(10) ORDER BY line_no) AS page_text, count(*) AS n_lines
  FROM lines GROUP BY 1, 2
)"""

_SQL_PAYOR = "CASE " + " ".join(
    f"WHEN contains(lower(page_text), '{p}') THEN '{n}'" for p, n in PAYORS
) + " END"
_SQL_SUBJECT = " OR ".join(f"contains(lower(page_text), '{p}')" for p in PHRASES)

SQL_STARTS = f"""{SQL_PAGES},
seen AS (
  SELECT doc_id, page_no, CASE WHEN page_no > 1 THEN {_SQL_PAYOR} END AS payor,
         page_no > 1 AND ({_SQL_SUBJECT}) AS subject
  FROM pages
),
starts AS (
  SELECT doc_id, max(page_no) AS total_pages,
         coalesce(min(page_no) FILTER (WHERE payor IS NOT NULL),
                  min(page_no) FILTER (WHERE subject), max(page_no) + 1) AS denial_start_page,
         coalesce(arg_min(payor, page_no) FILTER (WHERE payor IS NOT NULL), 'Unknown') AS payor
  FROM seen GROUP BY doc_id
)"""


@query("denial_page_split", f"WITH {SQL_STARTS} SELECT * FROM starts")
def denial_page_split(t: Tables):
    return letters.denial_start(pages(t), PAYORS, PHRASES)


@query(
    "letter_sections",
    f"""WITH {SQL_STARTS}
SELECT doc_id, CASE WHEN page_no < denial_start_page THEN 'rebuttal' ELSE 'denial' END AS section,
       0 AS part_no, count(*) AS n_rows,
       string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) AS text
FROM pages JOIN starts USING (doc_id) GROUP BY 1, 2""",
)
def letter_sections(t: Tables):
    p = pages(t)
    return letters.letter_sections(p, letters.denial_start(p, PAYORS, PHRASES))


@query(
    "letter_library",
    f"""WITH {SQL_STARTS},
sections AS (
  SELECT doc_id,
    string_agg(page_text, chr(10) || chr(10) ORDER BY page_no)
      FILTER (WHERE page_no < denial_start_page) AS rebuttal,
    string_agg(page_text, chr(10) || chr(10) ORDER BY page_no)
      FILTER (WHERE page_no >= denial_start_page) AS denial
  FROM pages JOIN starts USING (doc_id) GROUP BY doc_id
)
SELECT sha256('letter_' || doc_id || '.pdf') AS letter_id, lang AS condition_name,
       'letter_' || doc_id || '.pdf' AS source_file, payor, 0 AS part_no,
       coalesce(rebuttal, '') AS rebuttal_text, coalesce(denial, '') AS denial_text,
       CAST(denial_start_page AS VARCHAR) AS denial_start, CAST(total_pages AS VARCHAR) AS n_pages
FROM documents JOIN starts USING (doc_id) JOIN sections USING (doc_id)""",
)
def letter_library(t: Tables):
    files = t.documents.select(
        "doc_id",
        "lang",
        F.concat(F.lit("letter_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias(
            "source_file"
        ),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    rows = letters.letter_library(
        files, pages(t), F.col("lang"), F.to_timestamp(F.lit("2024-01-01")),
        payors=PAYORS, phrases=PHRASES,
    )
    return rows.select(
        "letter_id", "condition_name", "source_file", "payor", "part_no", "rebuttal_text",
        "denial_text", F.col("metadata")["denial_start_page"].alias("denial_start"),
        F.col("metadata")["total_pages"].alias("n_pages"),
    )


@query(
    "definition_library",
    """SELECT CASE WHEN starts_with(lower(source || '_' || lang), 'src1')
         THEN substr(lower(source || '_' || lang), 5) ELSE lower(source || '_' || lang) END
         AS condition_name,
       source || '_' || upper(lang) || '.PDF' AS source_file, text AS definition_text,
       CASE WHEN quality = 1 THEN 'summary of ' || doc_id ELSE text END AS definition_summary
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def definition_library(t: Tables):
    summary = F.when(
        F.col("quality") == 1, F.concat(F.lit("summary of "), F.col("doc_id").cast("string"))
    ).when(F.col("quality") == 0, "")
    files = t.documents.join(t.labels, "doc_id", "left").select(
        F.concat("source", F.lit("_"), F.upper("lang"), F.lit(".PDF")).alias("source_file"),
        F.col("text").alias("definition_text"),
        summary.alias("definition_summary"),
    )
    return letters.definition_library(files, F.lit(None).cast("timestamp"), "src1").drop(
        "created_at"
    )


@query(
    "kv_reply_parse",
    """SELECT o_orderkey,
       CASE WHEN o_orderkey >= 10 AND o_orderstatus <> 'P'
            THEN left(CAST(o_orderkey AS VARCHAR), length(CAST(o_orderkey AS VARCHAR)) - 1) END
         AS hsp_account_id,
       CASE WHEN o_orderstatus = 'O' THEN 'Unknown' ELSE o_orderpriority || ': A' END AS payor,
       CASE WHEN o_totalprice >= 100000 THEN '87' || left(o_orderpriority, 1) END AS original_drg,
       CASE WHEN o_orderstatus <> 'F' THEN '872' END AS proposed_drg,
       o_orderstatus = 'F' AS is_condition_match
FROM orders""",
)
def kv_reply_parse(t: Tables):
    """Replies stated from orders: repeated keys, lower-case keys, NONE, empty values, noise."""
    o = t.orders
    number = F.col("o_orderkey").cast("string")
    status = F.col("o_orderstatus")
    # H, digits, and one digit more with a letter to drop; no H for status P
    account = F.concat(F.when(status == "P", "X").otherwise("h"), number, F.lit("Z"))
    drg = F.when(
        F.col("o_totalprice") >= 100000, F.concat(F.lit("87"), F.left("o_orderpriority", F.lit(1)))
    ).otherwise("None")
    reply = F.concat(
        F.lit("ACCOUNT_ID: "), account,
        F.lit("\nno key here\npayor: first\nPAYOR: "),
        F.when(status != "O", F.concat("o_orderpriority", F.lit(": A"))).otherwise(""),
        F.lit("\n ORIGINAL_DRG : "), drg,
        F.lit("\nPROPOSED_DRG: "), F.when(status == "F", "NONE").otherwise("872"),
        F.lit("\nproposed_drg: None"),
        F.lit("\nIS_SEPSIS: "), F.when(status == "F", "yes").otherwise("no"),
    )
    return letters.denial_fields(o.select("o_orderkey", reply.alias("reply")), SEPSIS)


@query(
    "conflict_lines",
    """SELECT conv_id AS account_id, turn, role = 'user' AS none_detected,
       array_to_string(list_filter(list_transform(string_split(text, chr(10)),
           lambda x, i: trim('CONFLICT ' || i || ': ' || x)),
         lambda y: trim(regexp_replace(y, '^[^:]*:', '')) <> ''), ' / ') AS conflicts,
       'see ' || role AS recommendation
FROM conversations""",
)
def conflict_lines(t: Tables):
    """Every line of every text stated as a conflict, among lines that are none."""
    stated = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(F.lit("CONFLICT "), (i + 1).cast("string"), F.lit(": "), line),
    )
    reply = F.concat(
        F.array_join(stated, "\n  "),
        F.lit("\nCONFLICT 3:\nCONFLICT without colon\nRECOMMENDATION: early\n"),
        F.when(F.col("role") == "user", "NO CONFLICTS DETECTED\n").otherwise("\n"),
        F.lit("RECOMMENDATION: see "), "role",
    )
    rows = crosscheck.conflict_lines(
        t.conversations.select(F.col("conv_id").alias("account_id"), "turn", reply.alias("reply"))
    )
    return rows.withColumn("conflicts", F.array_join("conflicts", " / "))


# --- duplicates and scans ---------------------------------------------------------------------

SQL_OPENINGS = """
normal AS (
  SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS t
  FROM documents
),
prints AS (SELECT doc_id, t AS exact_key, left(t, 200) AS partial_key FROM normal)"""


@query(
    "duplicate_letters",
    f"""WITH {SQL_OPENINGS}
SELECT a.doc_id, count(*) FILTER (WHERE a.exact_key = b.exact_key) AS n_exact,
       count(*) FILTER (WHERE a.exact_key <> b.exact_key) AS n_partial,
       CASE WHEN count(*) FILTER (WHERE a.exact_key = b.exact_key) > 0 THEN 'EXACT'
            ELSE 'PARTIAL' END AS match_type,
       CASE WHEN count(*) FILTER (WHERE a.exact_key = b.exact_key) > 0
            THEN least(a.doc_id, min(b.doc_id) FILTER (WHERE a.exact_key = b.exact_key))
            ELSE least(a.doc_id, min(b.doc_id)) END AS first_doc_id
FROM prints a JOIN prints b ON a.partial_key = b.partial_key AND a.doc_id <> b.doc_id
GROUP BY a.doc_id""",
)
def duplicate_letters(t: Tables):
    return letters.duplicate_letters(staged(letters.fingerprints(t.documents)))


@query(
    "duplicate_members",
    f"""WITH {SQL_OPENINGS}
SELECT doc_id, min(doc_id) OVER (PARTITION BY exact_key) AS group_id,
       count(*) OVER (PARTITION BY exact_key) AS group_size
FROM prints QUALIFY count(*) OVER (PARTITION BY exact_key) > 1""",
)
def duplicate_members(t: Tables):
    return letters.group_members(staged(letters.fingerprints(t.documents)))


@query(
    "sample_matches",
    f"""WITH {SQL_OPENINGS}
SELECT a.doc_id, count(*) FILTER (WHERE a.exact_key = b.exact_key) AS n_exact,
       count(*) FILTER (WHERE a.exact_key <> b.exact_key) AS n_partial,
       CASE WHEN count(*) FILTER (WHERE a.exact_key = b.exact_key) > 0 THEN 'EXACT'
            ELSE 'PARTIAL' END AS match_type,
       coalesce(min(b.doc_id) FILTER (WHERE a.exact_key = b.exact_key), min(b.doc_id))
         AS first_doc_id
FROM prints a JOIN documents USING (doc_id)
JOIN (SELECT p.* FROM prints p JOIN documents USING (doc_id) WHERE lang <> 'en') b
  ON a.partial_key = b.partial_key
WHERE lang <> 'de'
GROUP BY a.doc_id""",
)
def sample_matches(t: Tables):
    """Letters not in German against those not in English."""
    docs = t.documents.select("doc_id", "text", "lang")
    return letters.matched_letters(docs.filter("lang <> 'de'"), docs.filter("lang <> 'en'"))


@query(
    "scan_confidence",
    f"""WITH {SQL_PAGES},
metrics AS (
  SELECT doc_id, count(*) AS page_count, CAST(sum(n_lines) AS BIGINT) AS total_lines,
         CAST(sum(length(page_text)) + count(*) - 1 AS BIGINT) AS char_count
  FROM pages GROUP BY doc_id
),
scored AS (
  SELECT m.*, CASE WHEN source IN ('src0', 'src1') THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE,
      0.5::DOUBLE * CASE WHEN char_count / page_count < 50 THEN 1.0
            WHEN char_count / page_count < 100 THEN 0.8
            WHEN char_count / page_count < 200 THEN 0.4 ELSE 0 END
    + 0.3::DOUBLE * CASE WHEN total_lines / page_count < 5 THEN 1.0
            WHEN total_lines / page_count < 10 THEN 0.6
            WHEN total_lines / page_count < 20 THEN 0.3 ELSE 0 END
    + 0.2::DOUBLE * ((n_chars % 10) / 10.0::DOUBLE)) END AS scan_confidence
  FROM metrics m JOIN documents USING (doc_id)
)
SELECT doc_id, page_count, total_lines, char_count, round(scan_confidence, 6) AS scan_confidence,
       scan_confidence > 0.7 AS is_scanned, scan_confidence <= 0.7 AND char_count >= 50 AS is_usable,
       CASE WHEN scan_confidence > 0.7 THEN 'Likely scanned document (confidence: '
              || printf('%.0f', scan_confidence * 100) || '%)'
            WHEN char_count < 50 THEN 'Insufficient text extracted (' || char_count || ' chars)'
       END AS skip_reason
FROM scored""",
)
def scan_confidence(t: Tables):
    kinds = t.documents.select(
        "doc_id",
        F.when(F.col("source").isin("src0", "src1"), "docx").otherwise("pdf").alias("file_type"),
        (F.col("n_chars") % 10).alias("handwritten"),
    )
    metrics = letters.page_metrics(pages(t)).join(kinds, "doc_id")
    confidence = letters.scan_confidence(
        F.col("file_type"), F.col("page_count"), F.col("total_lines"), F.col("char_count"),
        F.col("handwritten"), F.lit(10),
    )
    rows = letters.usability(metrics.withColumn("scan_confidence", confidence))
    return rows.drop("file_type", "handwritten").withColumn(
        "scan_confidence", F.round("scan_confidence", 6)
    )


# --- rules about denials ----------------------------------------------------------------------


@query(
    "condition_type",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'sepsis'
    WHEN n_chars % 7 = 0 THEN 'pneumonia' WHEN n_chars % 7 = 1 THEN 'cardiac'
    WHEN n_chars % 7 = 2 THEN 'sepsis'
    ELSE coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda l:
      CASE WHEN contains(lower(l), 'sepsis') OR contains(lower(l), 'septic') THEN 'sepsis'
           WHEN contains(lower(l), 'pneumonia') THEN 'pneumonia'
           WHEN contains(lower(l), 'cardiac') OR contains(lower(l), 'heart')
             OR contains(lower(l), 'mi') THEN 'cardiac' END), lambda x: x IS NOT NULL)[1], 'default')
    END AS condition_type
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def condition_type(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    kind = F.col("n_chars") % 7
    original = F.when(kind == 0, "193").when(kind == 1, "281").otherwise("999")
    proposed = F.when(kind == 2, "871").otherwise("000")
    found = letters.condition_type(
        F.col("toxic") == 1, original, proposed, F.split("text", "\n")
    )
    return rows.select("doc_id", found.alias("condition_type"))


CRITERIA = {
    "default": {"labs": ("BOLT", "RING"), "vitals": ("GEAR",)},
    "SMALL": {"labs": ("ANVIL",), "vitals": (), "meds": ("HOT", "COLD")},
    "LARGE": {"procedures": ("RED",), "labs": ("ROD", "PLATE")},
}
_SQL_KIND = (
    "CASE p_size % 4 WHEN 0 THEN 'labs' WHEN 1 THEN 'vitals' WHEN 2 THEN 'meds' "
    "ELSE 'procedures' END"
)


def _sql_criteria() -> str:
    tests = []
    for condition, kinds in CRITERIA.items():
        for kind, words in kinds.items():
            for word in words:
                tests.append(
                    f"(condition = '{condition}' AND kind = '{kind}' "
                    f"AND contains(upper(p_name), '{word}'))"
                )
    return f"""SELECT l_orderkey AS account_id, l_linenumber, kind AS data_type, p_name AS name
FROM (SELECT *, {_SQL_KIND} AS kind, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_type
        ELSE 'default' END AS condition FROM part)
JOIN lineitem ON l_partkey = p_partkey WHERE {" OR ".join(tests)}"""


@query("criteria_filter", _sql_criteria())
def criteria_filter(t: Tables):
    size = F.col("p_size") % 4
    kind = F.when(size == 0, "labs").when(size == 1, "vitals").when(size == 2, "meds")
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("account_id"),
        "l_linenumber",
        "p_type",
        kind.otherwise("procedures").alias("data_type"),
        F.col("p_name").alias("name"),
    )
    hit = letters.criteria_hit(F.col("p_type"), F.col("data_type"), F.col("name"), CRITERIA)
    return rows.filter(hit).drop("p_type")


@query(
    "search_tags",
    """SELECT o_orderkey, concat_ws('|',
         CASE WHEN o_orderstatus <> 'O' THEN 'drg_' || left(o_orderpriority, 1) END,
         CASE WHEN o_totalprice > 200000 THEN 'drg_872' END,
         CASE WHEN o_orderstatus = 'F' THEN 'sepsis|severe_sepsis|septic_shock' END,
         o_orderpriority, 'unknown') AS tags,
       CASE WHEN o_orderstatus = 'P' THEN o_orderstatus || ' summary ' ELSE '' END
         || o_orderpriority || ' ' || o_orderstatus AS query_text
FROM orders""",
)
def search_tags(t: Tables):
    status = F.col("o_orderstatus")
    tags = letters.search_tags(
        F.when(status != "O", F.left("o_orderpriority", F.lit(1))).otherwise(""),
        F.when(F.col("o_totalprice") > 200000, "872"),
        status == "F",
        F.array(F.col("o_orderpriority"), F.lit(None).cast("string")),
    )
    reason = F.struct(
        F.when(status == "P", F.concat(status, F.lit(" summary"))).otherwise("").alias("summary"),
        F.array("o_orderpriority", status).alias("arguments"),
    )
    return t.orders.select(
        "o_orderkey",
        F.array_join(tags, "|").alias("tags"),
        letters.query_text(F.array(reason)).alias("query_text"),
    )


# --- similarity -------------------------------------------------------------------------------

SQL_COSINE = """
scored AS (
  SELECT q.vec_id AS query_id, l.vec_id AS letter_id,
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])),
               9) AS score
  FROM embeddings q JOIN embeddings l ON q.vec_id <> l.vec_id
)"""


def vectors(t: Tables):
    """Every vector is a case and a past letter; a case does not match itself."""
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    library = t.embeddings.select(F.col("vec_id").alias("letter_id"), "embedding")
    return queries, library


def _sql_best(threshold: float) -> str:
    return f"""WITH {SQL_COSINE},
top AS (SELECT * FROM scored WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, letter_id) = 1)
SELECT vec_id AS query_id,
       CASE WHEN score >= {threshold} THEN letter_id ELSE -1 END AS letter_id,
       CASE WHEN score >= {threshold} THEN round(score, 6) ELSE 0 END AS score,
       NOT coalesce(score >= {threshold}, false) AS is_default
FROM embeddings LEFT JOIN top ON query_id = vec_id"""


def _best(t: Tables, threshold: float):
    rows = similarity.best_match(*vectors(t), threshold, -1, exclude_same=True)
    return rows.withColumn("score", F.round("score", 6))


@query("template_match_top1", _sql_best(0.7))
def template_match_top1(t: Tables):
    return _best(t, 0.7)


@query("template_match_top1_low", _sql_best(0.4))
def template_match_top1_low(t: Tables):
    return _best(t, 0.4)


@query(
    "template_match_topk",
    f"""WITH {SQL_COSINE},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, letter_id) AS rank
  FROM scored QUALIFY rank <= 10),
best AS (SELECT query_id, max(score) AS best, count(*) AS n_matches FROM top GROUP BY 1)
SELECT query_id, n_matches, best < 0.4 AS use_fallback,
       CASE WHEN best < 0.4 THEN 'Best match score (' || printf('%.2f', best)
            || ') below threshold (0.4)' END AS fallback_reason,
       letter_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
FROM best JOIN top USING (query_id)""",
)
def template_match_topk(t: Tables):
    rows = similarity.matches_with_reason(*vectors(t), 10, 0.4, exclude_same=True)
    return rows.withColumn("score", F.round("score", 6))


@query(
    "similar_letters",
    """WITH o AS (
  SELECT doc_id, left(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 200) AS t FROM documents
),
g AS (SELECT t, min(doc_id) AS first_id, count(*) AS n, string_split(t, '') AS c FROM o WHERE t <> '' GROUP BY t),
p AS (
  SELECT a.t, sum(b.n)::BIGINT AS n_similar, min(b.first_id) AS other
  FROM g a JOIN g b ON length(a.t) = length(b.t) AND a.t <> b.t
  WHERE 100 * len(list_filter(list_zip(a.c, b.c), lambda x: x[1] = x[2])) >= 95 * length(a.t) GROUP BY a.t
)
SELECT doc_id, n - 1 AS n_same, coalesce(n_similar, 0) AS n_similar, least(first_id, coalesce(other, first_id)) AS first_doc_id
FROM o JOIN g USING (t) LEFT JOIN p USING (t) WHERE n > 1 OR n_similar IS NOT NULL""",
)
def similar_letters(t: Tables):
    return letters.similar_letters(t.documents)


@query(
    "criteria_retrieval",
    """WITH criteria AS (
  SELECT p_partkey AS criteria_id, unnest([p_type, p_brand]) AS signal FROM part
),
requests AS (
  SELECT c_custkey AS request_id, CASE WHEN c_acctbal >= 0 THEN
    ['Brand#' || (c_nationkey + 1), CASE WHEN c_acctbal > 5000 THEN 'PROMO' ELSE 'NONE' END] END
    AS signals FROM customer
),
hits AS (
  SELECT DISTINCT request_id, criteria_id
  FROM (SELECT request_id, unnest(signals) AS signal FROM requests) JOIN criteria USING (signal)
  UNION ALL
  SELECT request_id, criteria_id FROM requests, (SELECT DISTINCT criteria_id FROM criteria)
  WHERE signals IS NULL
)
SELECT request_id, criteria_id, CAST(row_number() OVER (PARTITION BY request_id
  ORDER BY criteria_id) AS INTEGER) AS rank FROM hits QUALIFY rank <= 5""",
)
def criteria_retrieval(t: Tables):
    signals = F.array(
        F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")),
        F.when(F.col("c_acctbal") > 5000, "PROMO").otherwise("NONE"),
    )
    requests = t.customer.select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_acctbal") >= 0, signals).alias("signals"),
    )
    criteria = t.part.select(
        F.col("p_partkey").alias("criteria_id"), F.array("p_type", "p_brand").alias("relevance")
    )
    return similarity.retrieve_criteria(requests, criteria)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _sql_tokens(column: str) -> str:
    return (
        f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({column}), "
        f"'[^a-z0-9 ]', '', 'g'), ' +'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"
    )


@query(
    "guideline_match",
    f"""WITH documents_ AS (
  SELECT p_brand || ' ' || min(p_name) AS file_name,
         p_brand || coalesce(',' || string_agg(DISTINCT 'Z' || p_size, ',')
           FILTER (WHERE p_type = 'ECONOMY'), '') AS codes
  FROM part GROUP BY p_brand
),
coded AS (
  SELECT file_name, {_sql_tokens("file_name")} AS file_tokens,
         unnest(string_split(codes, ',')) AS code FROM documents_
),
facts AS (
  SELECT DISTINCT CASE WHEN p_size <= 15 THEN 'Z' || p_size END AS dx_code, p_name AS dx_name,
         CASE WHEN p_size > 40 THEN 'Z' || p_size END AS proc_code, p_brand AS px_name,
         {_sql_tokens("p_name")} AS dx_tokens
  FROM part
),
scored AS (
  SELECT dx_code, dx_name, proc_code, px_name, file_name, len(file_tokens) AS n,
         len(list_intersect(dx_tokens, file_tokens)) / len(dx_tokens) AS similarity,
         CASE WHEN code = dx_code THEN 1.0 WHEN code = proc_code THEN 0.8
              WHEN code = px_name THEN 0.6
              ELSE 0.2 * (len(list_intersect(dx_tokens, file_tokens)) / len(dx_tokens)) END
           AS combined
  FROM facts JOIN coded ON code = dx_code OR code = proc_code
    OR len(list_intersect(dx_tokens, file_tokens)) > 0
),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (
    PARTITION BY dx_code, dx_name, proc_code, px_name
    ORDER BY combined DESC, similarity DESC, n DESC, file_name) = 1
)
SELECT l_orderkey AS account_id, l_linenumber AS line, p_partkey AS part, best.file_name,
       round(similarity, 6) AS similarity, round(combined, 6) AS combined
FROM lineitem JOIN part ON p_partkey = l_partkey
LEFT JOIN best ON best.dx_name = p_name AND best.px_name = p_brand
  AND best.dx_code IS NOT DISTINCT FROM (CASE WHEN p_size <= 15 THEN 'Z' || p_size END)
  AND best.proc_code IS NOT DISTINCT FROM (CASE WHEN p_size > 40 THEN 'Z' || p_size END)""",
)
def guideline_match(t: Tables):
    size = F.concat(F.lit("Z"), F.col("p_size").cast("string"))
    economy = F.array_sort(F.collect_set(F.when(F.col("p_type") == "ECONOMY", size)))
    documents = t.part.groupBy("p_brand").agg(
        F.concat("p_brand", F.lit(" "), F.min("p_name")).alias("file_name"),
        F.concat_ws(",", "p_brand", economy).alias("codes"),
    )
    diagnoses = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("account_id"),
        F.col("l_linenumber").alias("line"),
        F.col("p_partkey").alias("part"),
        F.when(F.col("p_size") <= 15, size).alias("dx_code"),
        F.col("p_name").alias("dx_name"),
        F.when(F.col("p_size") > 40, size).alias("proc_code"),
        F.col("p_brand").alias("px_name"),
    )
    rows = guidelines.best_guidelines(diagnoses, documents.select("file_name", "codes"))
    return rows.select(
        "account_id", "line", "part", "file_name",
        F.round("similarity", 6).alias("similarity"), F.round("combined", 6).alias("combined"),
    )


# --- assessments and letters ------------------------------------------------------------------


@query(
    "assessment_flatten",
    """WITH found AS (
  SELECT o_orderkey AS account_id, unnest([
    {'ord': 0, 'dimension': 'SOURCE FIDELITY', 'score': left(o_orderpriority, 1), 'item_no': 0,
     'status': 'present', 'mark': '✓', 'item': o_orderpriority},
    {'ord': 1, 'dimension': 'CRITERIA', 'score': '7', 'item_no': 0, 'status': 'missing',
     'mark': '✗', 'item': 'first'},
    {'ord': 1, 'dimension': 'CRITERIA', 'score': '7', 'item_no': 1, 'status': 'could_strengthen',
     'mark': '△', 'item': o_orderstatus},
    {'ord': 3, 'dimension': 'EVIDENCE - Clinical Notes', 'score': '?', 'item_no': 0,
     'status': 'odd', 'mark': '?', 'item': ''}]) AS f
  FROM orders WHERE o_orderstatus <> 'P'
)
SELECT account_id, f.ord, f.dimension, f.score, f.item_no, f.status, f.mark, f.item FROM found""",
)
def assessment_flatten(t: Tables):
    return report.assessment_rows(report.parsed_assessment(assessments(t)))


def assessments(t: Tables):
    """Assessment replies written from orders; those of status P are cut off and do not parse."""
    body = F.concat(
        F.lit('```json\n{"overall_score": '), F.floor(F.col("o_totalprice") / 30000).cast("string"),
        F.lit(', "overall_rating": "'), "o_orderpriority",
        F.lit('", "summary": "about '), "o_orderstatus",
        F.lit('", "source_fidelity": {"score": '), F.left("o_orderpriority", F.lit(1)),
        F.lit(', "findings": [{"status": "present", "item": "'), "o_orderpriority",
        F.lit('"}]}, "criteria": {"score": 7, "findings": [{"status": "missing", "item": "first"}, '
              '{"status": "could_strengthen", "item": "'), "o_orderstatus",
        F.lit('"}]}, "evidence_quality": {"clinical_notes": {"findings": [{"status": "odd"}]}}'),
        F.when(F.col("o_orderstatus") == "P", "").otherwise("}\n```"),
    )
    return t.orders.select(F.col("o_orderkey").alias("account_id"), body.alias("reply"))


@query(
    "assessment_scores",
    """SELECT o_orderkey AS account_id,
  CASE WHEN o_orderstatus <> 'P' THEN
    CAST(greatest(1, least(10, floor(o_totalprice / 30000))) AS DOUBLE) END AS overall_score,
  CASE WHEN o_orderstatus <> 'P' THEN
    CASE WHEN greatest(1, least(10, floor(o_totalprice / 30000))) <= 4 THEN 'LOW'
         WHEN greatest(1, least(10, floor(o_totalprice / 30000))) <= 7 THEN 'MODERATE'
         ELSE 'HIGH' END END AS band
FROM orders""",
)
def assessment_scores(t: Tables):
    parsed = report.parsed_assessment(assessments(t))
    ok = F.col("assessment").isNotNull()
    score = F.when(ok, F.col("overall_score"))
    return parsed.select(
        "account_id", score.cast("double").alias("overall_score"), rating(score).alias("band")
    )


@query(
    "letter_text",
    """SELECT c_custkey AS account_id, concat_ws(chr(10),
  c_name || ' street', '', '01/01/2024', '', 'NATION ' || c_nationkey, '',
  CASE WHEN c_acctbal > 0 THEN 'Second Level Appeal' ELSE 'First Level Appeal' END, '',
  'Beneficiary Name: ' || c_name, 'DOB: ', 'Claim reference #: ' || c_custkey,
  'Hospital Account #: ', 'Date of Service: ', '', 'Dear ' || c_mktsegment, '', 'Opening', '',
  'Justification for Appeal:', '', '', '', 'Rationale:', '',
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Quoted' || chr(10) END,
  'Infection Source: ' || c_mktsegment, '',
  'Organ Dysfunction:', CASE WHEN c_custkey % 3 = 0 THEN '  - stated in words ' || c_nationkey
    ELSE '  - balance: ' || c_nationkey || ' (threshold: )' END, '',
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Other Conditions:' || chr(10) || '  - a' || chr(10)
    || '  - b' || chr(10) END,
  'Hospital Course:', 'short', '', '', '', 'Conclusion:', '', 'End', '',
  'Please direct all written correspondence to:', '', '', '', 'Sincerely,', '', 'Signed')
  AS letter_text
FROM customer""",
)
def letter_text(t: Tables):
    body = F.to_json(
        F.struct(
            F.struct(
                F.concat("c_name", F.lit(" street")).alias("address"),
                F.lit("01/01/2024").alias("date"),
            ).alias("header"),
            F.concat(F.lit("NATION "), F.col("c_nationkey").cast("string")).alias("payor_address"),
            F.when(F.col("c_acctbal") > 0, "Second Level Appeal").alias("appeal_level"),
            F.struct(
                F.col("c_name").alias("beneficiary_name"),
                F.col("c_custkey").cast("string").alias("claim_reference"),
            ).alias("patient_info"),
            F.concat(F.lit("Dear "), "c_mktsegment").alias("salutation"),
            F.lit("Opening").alias("opening_paragraph"),
            F.struct(
                F.when(F.col("c_mktsegment") == "BUILDING", "Quoted").alias("payor_argument_quote"),
                F.col("c_mktsegment").alias("infection_source"),
                F.array(F.lit("@evidence@")).alias("organ_dysfunction"),
                F.when(
                    F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("a"), F.lit("b"))
                ).alias("other_conditions"),
            ).alias("rationale"),
            F.lit("short").alias("hospital_course"),
            F.lit("End").alias("conclusion"),
            F.lit("Signed").alias("signature_block"),
        )
    )
    # of three letters one states its evidence in words, and every other one is wrapped
    nation = F.col("c_nationkey").cast("string")
    evidence = F.when(
        F.col("c_custkey") % 3 == 0, F.concat(F.lit('"stated in words '), nation, F.lit('"'))
    ).otherwise(F.concat(F.lit('{"criterion":"balance","value":"'), nation, F.lit('"}')))
    body = F.replace(body, F.lit('"@evidence@"'), evidence)
    wrapped = F.concat(F.lit('{"letter":'), body, F.lit("}"))
    reply = F.when(F.col("c_custkey") % 2 == 0, wrapped).otherwise(body)
    return t.customer.select(
        F.col("c_custkey").alias("account_id"), report.letter_text(reply).alias("letter_text")
    )


@query(
    "letter_runs",
    """WITH paragraphs AS (
  SELECT conv_id, turn, generate_subscripts(p, 1) - 1 AS paragraph_no, unnest(p) AS body
  FROM (SELECT conv_id, turn, [trim(text, ' ' || chr(10) || chr(9) || chr(13)),
                               'as ' || role || ' said'] AS p, text FROM conversations)
)
SELECT conv_id, turn, CAST(paragraph_no AS INTEGER) AS paragraph_no, r.run_no, r.text, r.bold
FROM (
  SELECT *, unnest(CASE WHEN paragraph_no = 0 THEN [
      {'run_no': 0, 'text': 'Note ', 'bold': false}, {'run_no': 1, 'text': turn::VARCHAR, 'bold': true},
      {'run_no': 2, 'text': ': ' || body, 'bold': false}]
    ELSE [{'run_no': 0, 'text': body, 'bold': true}] END) AS r
  FROM paragraphs
)""",
)
def letter_runs(t: Tables):
    text = F.concat(
        F.lit("Note **"), F.col("turn").cast("string"), F.lit("**: "),
        F.regexp_replace("text", r"\n\n+", "\n"),
        F.lit(" \n\n  \n\n**as "), "role", F.lit(" said**"),
    )
    rows = t.conversations.select("conv_id", "turn", text.alias("letter_text"))
    return report.letter_runs(rows, ("conv_id", "turn"))
