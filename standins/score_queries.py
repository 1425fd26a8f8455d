"""Nearest readings, ratios, SOFA, cross-check and what is reported of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseflow.operators import crosscheck, matchers, report, scores
from caseflow.operators.asof import Series, nearest
from caseflow.profiles import ORGAN_NAMES, RESPIRATORY_FAILURE, SEPSIS, SOFA_CRITERIA
from caseflow.session import checkpoint_dir
from caseflow.sources.sinks import staged, write_keyed
from caseflow.streaming.incremental import refresh, touched
from standins import clinical as c
from standins.registry import Tables, rounded, query

DAY_US = 86_400_000_000


def clicks_and_views(t: Tables):
    e = t.events.select("user_id", "event_id", "event_type", "ts", "value")
    return e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'view'")


def _sql_nearest(tolerance: int | None) -> str:
    limit = "" if tolerance is None else f"AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= {tolerance}"
    return f"""
SELECT l.user_id, l.event_id, r.value AS near_value, CAST(epoch_us(r.ts) AS DOUBLE) AS near_us,
       CAST(abs(epoch_us(l.ts) - epoch_us(r.ts)) AS DOUBLE) AS gap_us
FROM events l LEFT JOIN events r
  ON l.user_id = r.user_id AND r.event_type = 'view' {limit}
WHERE l.event_type = 'click'
QUALIFY row_number() OVER (PARTITION BY l.event_id
  ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.value) = 1"""


def _nearest(t: Tables, tolerance: int | None):
    click, view = clicks_and_views(t)
    series = {"near": Series(view, "ts", ["value"], ["value", "event_id"], tolerance)}
    return nearest(click, ["user_id"], "ts", series).select(
        "user_id",
        "event_id",
        F.col("near.value").alias("near_value"),
        F.col("near.us").cast("double").alias("near_us"),
        F.col("near.gap_us").cast("double").alias("gap_us"),
    )


@query("nearest_unbounded", _sql_nearest(None))
def nearest_unbounded(t: Tables):
    return _nearest(t, None)


@query("nearest_tolerance", _sql_nearest(1_800_000_000))
def nearest_tolerance(t: Tables):
    return _nearest(t, 1_800_000_000)


@query("nearest_one_day", _sql_nearest(DAY_US))
def nearest_one_day(t: Tables):
    return _nearest(t, DAY_US)


# --- ratios -----------------------------------------------------------------------------------

FRACTION = "CASE WHEN f.found <= 1.0 THEN f.found ELSE f.found / 100 END"

SQL_PF = f"""{c.SQL_READINGS},
{c.sql_pairs("fio2", "fio2", 1800, True)},
{c.sql_pairs("peep", "peep", 7200)},
measured AS (
  SELECT f.account_id, f.us, f.pao2, f.found AS fio2_raw, {FRACTION} AS fio2_normalized,
         p.found AS peep, {rounded(f"(f.pao2 / ({FRACTION}))", 1)} AS ratio
  FROM fio2 f LEFT JOIN peep p ON p.account_id = f.account_id AND p.event_id = f.event_id
),
series AS (
  SELECT account_id, CAST(row_number() OVER (PARTITION BY account_id
           ORDER BY us // 1000000, us, pao2, fio2_raw) - 1 AS INTEGER) AS position,
         us, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS timestamp,
         pao2, fio2_raw, fio2_normalized, peep, ratio,
         CASE WHEN ratio <= 100 THEN 'Severe ARDS' WHEN ratio <= 200 THEN 'Moderate ARDS'
              WHEN ratio <= 300 THEN 'Mild ARDS' ELSE 'Normal' END AS classification
  FROM measured
),
worst AS (
  SELECT account_id, ratio, classification, timestamp FROM series
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY ratio, position) = 1
),
pf AS (
  SELECT s.account_id, CAST(count(*) AS INTEGER) AS measurements_calculated,
         CAST(count(*) AS INTEGER) AS total_score, CAST(count(*) AS INTEGER) AS organs_scored,
         CAST(count(CASE WHEN s.ratio < 300 THEN 1 END) AS INTEGER) AS n_qualifying,
         any_value(w.ratio) AS worst_ratio, any_value(w.classification) AS worst_classification,
         any_value(w.timestamp) AS worst_timestamp,
         min(s.timestamp) AS window_start, max(s.timestamp) AS window_end,
         'full_encounter' AS window_mode
  FROM series s JOIN worst w ON w.account_id = s.account_id GROUP BY s.account_id
)"""


def pf(t: Tables):
    return scores.pf_series(c.reading_labs(t), c.reading_vitals(t))


def pf_staged(t: Tables):
    return staged(pf(t))


@query("pf_series", f"WITH {SQL_PF} SELECT * FROM series")
def pf_series(t: Tables):
    return pf(t)


@query("pf_worst", f"WITH {SQL_PF} SELECT * FROM pf")
def pf_worst(t: Tables):
    return scores.pf_summary(pf(t))


@query(
    "pf_score_rows",
    f"""WITH {SQL_PF}
SELECT c_custkey AS account_id, coalesce(measurements_calculated, 0) AS measurements_calculated,
  coalesce(total_score, 0) AS total_score, coalesce(organs_scored, 0) AS organs_scored,
  coalesce(n_qualifying, 0) AS n_qualifying, worst_ratio, worst_classification, worst_timestamp,
  window_start, window_end, 'full_encounter' AS window_mode
FROM customer LEFT JOIN pf ON pf.account_id = c_custkey""",
)
def pf_score_rows(t: Tables):
    """Customers are the cases; most have no ratio and get the empty row."""
    cases_ = t.customer.select(F.col("c_custkey").alias("account_id"))
    rows = scores.pf_rows(cases_, scores.pf_summary(pf(t)), F.current_timestamp())
    return rows.drop("created_at")


SQL_PF_CELLS = """
cells AS (
  SELECT *, CASE WHEN fio2_raw > 1.0
      THEN CAST(fio2_raw AS VARCHAR) || '% (' || printf('%.2f', fio2_normalized) || ')'
      ELSE CAST(fio2_raw AS VARCHAR) || ' (' || printf('%.0f', fio2_normalized * 100) || '%)' END
      AS fio2_shown,
    coalesce(CAST(peep AS VARCHAR), 'N/A (no vent data)') AS peep_shown
  FROM series
)"""


@query(
    "pf_table_text",
    f"""WITH {SQL_PF}, {SQL_PF_CELLS},
lines AS (
  SELECT account_id, string_agg('| ' || timestamp || ' | ' || CAST(pao2 AS VARCHAR) || ' | '
    || fio2_shown || ' | ' || peep_shown || ' | ' || CAST(ratio AS VARCHAR) || ' | '
    || classification || ' |', chr(10) ORDER BY position) AS body
  FROM cells GROUP BY account_id
)
SELECT account_id, 0 AS part_no,
  CASE WHEN n_qualifying > 0 THEN
    'P/F RATIO MEASUREMENTS (calculated from raw ABG data — ' || measurements_calculated
    || ' measurement(s), full encounter):' || chr(10) || 'Worst P/F ratio: '
    || CAST(worst_ratio AS VARCHAR) || ' (' || worst_classification || ') at ' || worst_timestamp
    || chr(10) || chr(10)
    || '| Timestamp | PaO2 (mmHg) | FiO2 | PEEP (cmH2O) | P/F Ratio | Berlin Classification |'
    || chr(10) || '|---|---|---|---|---|---|' || chr(10) || body || chr(10) || chr(10)
    || 'Cite the computed P/F ratios as they stand.'
  ELSE 'P/F RATIO DATA: ' || measurements_calculated
    || ' measurement(s) calculated. All ratios >= 300 (worst = ' || CAST(worst_ratio AS VARCHAR)
    || ').'
  END AS scores_text
FROM pf JOIN lines USING (account_id)""",
)
def pf_table_text(t: Tables):
    series = pf_staged(t)
    return report.pf_text(series, scores.pf_summary(series), RESPIRATORY_FAILURE)


def cases(t: Tables):
    return t.events.select(F.col("user_id").alias("account_id")).distinct()


@query(
    "pf_report_rows",
    f"""WITH {SQL_PF}, {SQL_PF_CELLS},
cases AS (SELECT DISTINCT user_id AS account_id FROM events)
SELECT c.account_id, 'status_note' AS section, 0 AS ord, 'P/F Ratio Table: ' AS c1,
  CASE WHEN p.account_id IS NULL THEN '{report.PF_NOTE_NO_DATA}'
    ELSE 'Not included — ' || measurements_calculated || ' measurement(s) calculated but all P/F '
      || 'ratios >= 300 (worst = ' || CAST(worst_ratio AS VARCHAR) || ' at ' || worst_timestamp
      || '). No ARF-qualifying P/F values.' END AS c2,
  '' AS c3, '' AS c4, '' AS c5, '' AS c6, false AS highlight
FROM cases c LEFT JOIN pf p USING (account_id) WHERE coalesce(n_qualifying, 0) = 0
UNION ALL
SELECT account_id, 'window', 0, 'Data Scope: ', 'Full encounter (' || measurements_calculated
  || ' ABG measurement(s)). Window: ' || window_start || ' to ' || window_end || '.',
  '', '', '', '', false
FROM pf WHERE n_qualifying > 0
UNION ALL
SELECT account_id, 'measurement', position, timestamp, CAST(pao2 AS VARCHAR), fio2_shown,
  peep_shown, CAST(ratio AS VARCHAR), classification, ratio = worst_ratio
FROM cells JOIN (SELECT account_id, worst_ratio FROM pf WHERE n_qualifying > 0)
  USING (account_id)""",
)
def pf_report_rows(t: Tables):
    series = pf_staged(t)
    return report.pf_report(cases(t), series, scores.pf_summary(series), RESPIRATORY_FAILURE)


# --- SOFA -------------------------------------------------------------------------------------

SQL_EVENTS = f"""{c.SQL_READINGS},
{c.sql_pairs("fio2", "fio2", None, True)},
scored AS (
  SELECT account_id, us, 'coagulation' AS organ,
         CASE WHEN value < 20 THEN 4 WHEN value < 50 THEN 3 WHEN value < 100 THEN 2
              WHEN value < 150 THEN 1 ELSE 0 END AS score,
         value, CAST(value AS VARCHAR) AS display, CAST(NULL AS VARCHAR) AS drug,
         CAST(NULL AS DOUBLE) AS dose
  FROM readings WHERE category = 'platelets'
  UNION ALL
  SELECT account_id, us, 'liver', CASE WHEN value >= 12 THEN 4 WHEN value >= 6 THEN 3
         WHEN value >= 2 THEN 2 WHEN value >= 1.2 THEN 1 ELSE 0 END,
         value, CAST(value AS VARCHAR), NULL, NULL FROM readings WHERE category = 'bilirubin'
  UNION ALL
  SELECT account_id, us, 'renal', CASE WHEN value >= 5 THEN 4 WHEN value >= 3.5 THEN 3
         WHEN value >= 2 THEN 2 WHEN value >= 1.2 THEN 1 ELSE 0 END,
         value, CAST(value AS VARCHAR), NULL, NULL FROM readings WHERE category = 'creatinine'
  UNION ALL
  SELECT account_id, us, 'respiratory', CASE WHEN r < 100 THEN 4 WHEN r < 200 THEN 3
         WHEN r < 300 THEN 2 WHEN r < 400 THEN 1 ELSE 0 END,
         r, 'PaO2/FiO2 = ' || CAST({rounded("r", 1)} AS VARCHAR), NULL, NULL
  FROM (SELECT f.account_id, f.us, f.pao2 / ({FRACTION}) AS r FROM fio2 f)
  UNION ALL
  SELECT account_id, us, 'cardiovascular', CASE WHEN value < 70 THEN 1 ELSE 0 END,
         value, 'MAP = ' || CAST(value AS VARCHAR), NULL, NULL FROM readings WHERE category = 'map'
  UNION ALL
  SELECT account_id, us, 'cns', CASE WHEN value < 6 THEN 4 WHEN value < 10 THEN 3
         WHEN value < 13 THEN 2 WHEN value < 15 THEN 1 ELSE 0 END,
         value, 'GCS = ' || CAST(CAST(value AS INTEGER) AS VARCHAR), NULL, NULL
  FROM readings WHERE category = 'gcs'
  UNION ALL
  SELECT account_id, us, 'vasopressor',
         CASE WHEN drug = 'dopamine' AND dose > 15 THEN 4 WHEN drug = 'dopamine' AND dose > 5 THEN 3
              WHEN drug IN ('epinephrine', 'norepinephrine') AND dose > 0.1 THEN 4
              WHEN drug IN ('epinephrine', 'norepinephrine') THEN 3 ELSE 2 END,
         dose, drug || coalesce(' ' || CAST(dose AS VARCHAR), ''), drug, dose
  FROM (SELECT user_id AS account_id, epoch_us(ts) AS us,
          CASE event_id % 6 WHEN 0 THEN 'norepinephrine' WHEN 1 THEN 'epinephrine'
            WHEN 2 THEN 'dopamine' WHEN 3 THEN 'dobutamine' WHEN 4 THEN 'vasopressin'
            ELSE 'norepinephrine' END AS drug,
          CASE WHEN event_id % 7 <> 0 THEN value / 10 END AS dose
        FROM events WHERE event_type = 'error')
),
anchors AS (SELECT DISTINCT account_id, us FROM scored),
organ_max AS (
  SELECT a.account_id, a.us, CASE organ WHEN 'vasopressor' THEN 'cardiovascular' ELSE organ END
           AS organ, max(score) AS score
  FROM anchors a JOIN scored s ON s.account_id = a.account_id
    AND s.us BETWEEN a.us AND a.us + {DAY_US}
  GROUP BY ALL
),
best AS (
  SELECT account_id, us AS start_us, sum(score) AS total FROM organ_max GROUP BY account_id, us
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY total DESC, us) = 1
)"""

SQL_SOFA = """
inside AS (
  SELECT s.* FROM scored s JOIN windows w ON w.account_id = s.account_id
    AND s.us BETWEEN w.start_us AND w.end_us
),
plain AS (
  SELECT account_id, organ, score, display AS value, us FROM inside
  WHERE organ NOT IN ('cardiovascular', 'vasopressor')
  QUALIFY row_number() OVER (PARTITION BY account_id, organ
    ORDER BY score DESC, us, inside.value DESC) = 1
),
per_drug AS (
  SELECT account_id, drug, max(score) AS score, min(us) AS first_us FROM inside
  WHERE organ = 'vasopressor' GROUP BY 1, 2
),
drug_row AS (
  SELECT account_id, drug, display, us FROM inside WHERE organ = 'vasopressor'
  QUALIFY row_number() OVER (PARTITION BY account_id, drug ORDER BY dose DESC NULLS LAST, us) = 1
),
heart AS (
  SELECT account_id, score, value, us FROM (
    SELECT account_id, score, display AS value, us, 0 AS kind, us AS first_us FROM inside
    WHERE organ = 'cardiovascular' AND score > 0
    UNION ALL
    SELECT p.account_id, p.score, d.display, d.us, 1, p.first_us
    FROM per_drug p JOIN drug_row d USING (account_id, drug)
  )
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY score DESC, kind, first_us) = 1
),
organs AS (
  SELECT account_id, organ, CAST(score AS INTEGER) AS score, value,
         strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS timestamp
  FROM (SELECT account_id, organ, score, value, us FROM plain
        UNION ALL SELECT account_id, 'cardiovascular', score, value, us FROM heart)
),
sofa AS (
  SELECT w.account_id, CAST(coalesce(any_value(total), 0) AS INTEGER) AS total_score,
         CAST(coalesce(any_value(n), 0) AS INTEGER) AS organs_scored,
         any_value(vasopressors) AS vasopressors,
         strftime(make_timestamp(any_value(w.start_us)), '%Y-%m-%d %H:%M:%S') AS window_start,
         strftime(make_timestamp(any_value(w.end_us)), '%Y-%m-%d %H:%M:%S') AS window_end,
         any_value(window_mode) AS window_mode
  FROM windows w
  LEFT JOIN (SELECT account_id, sum(score) AS total, count(*) AS n FROM organs GROUP BY 1) USING
    (account_id)
  LEFT JOIN (SELECT account_id, string_agg(DISTINCT drug, ', ' ORDER BY drug) AS vasopressors
             FROM inside WHERE drug IS NOT NULL GROUP BY 1) USING (account_id)
  GROUP BY w.account_id
)"""

SQL_SLIDING = f"""{SQL_EVENTS},
windows AS (
  SELECT account_id, start_us, start_us + {DAY_US} AS end_us, 'sliding_best_score' AS window_mode
  FROM best
), {SQL_SOFA}"""

SQL_ANCHORED = f"""{SQL_EVENTS},
anchor AS (
  SELECT user_id AS account_id, min(epoch_us(ts)) AS admit_us,
         min(epoch_us(ts)) FILTER (WHERE event_type = 'error') AS dx_us,
         CASE user_id % 3 WHEN 0 THEN NULL ELSE user_id % 3 END AS poa
  FROM events GROUP BY user_id
),
windows AS (
  SELECT account_id, start_us, start_us + {DAY_US} AS end_us, window_mode FROM (
    SELECT b.account_id,
           CASE WHEN poa = 1 THEN admit_us WHEN poa = 2 AND dx_us IS NOT NULL THEN dx_us
                ELSE b.start_us END AS start_us,
           CASE WHEN poa = 1 THEN 'poa_anchored_admission'
                WHEN poa = 2 AND dx_us IS NOT NULL THEN 'poa_anchored_first_dx'
                ELSE 'sliding_best_score' END AS window_mode
    FROM best b JOIN anchor a ON a.account_id = b.account_id)
), {SQL_SOFA}"""

SOFA_COLUMNS = (
    "account_id", "total_score", "organs_scored", "vasopressors", "window_start", "window_end",
    "window_mode",
)


def sofa_events(t: Tables):
    return staged(scores.organ_events(c.reading_labs(t), c.reading_vitals(t), c.meds(t)))


def anchors(t: Tables):
    poa = F.pmod("user_id", F.lit(3)).cast("int")
    first = F.min(F.when(F.col("event_type") == "error", F.col("ts")))
    return (
        t.events.groupBy(F.col("user_id").alias("account_id"))
        .agg(
            F.min("ts").alias("admit_ts"),
            F.first(F.when(poa != 0, poa)).alias("poa_code"),
            first.alias("first_dx_ts"),
        )
    )


@query("sofa_sliding", f"WITH {SQL_SLIDING} SELECT {', '.join(SOFA_COLUMNS)} FROM sofa")
def sofa_sliding(t: Tables):
    return scores.sofa(sofa_events(t)).select(*SOFA_COLUMNS)


@query("refreshed_scores", f"WITH {SQL_SLIDING} SELECT {', '.join(SOFA_COLUMNS)} FROM sofa")
def refreshed_scores(t: Tables):
    """Scores stored up to a mark, then brought up to date for the accounts with events since."""
    tables = {"labs": c.reading_labs(t), "vitals": c.reading_vitals(t), "meds": c.meds(t)}

    def compute(x: dict):
        events = staged(scores.organ_events(x["labs"], x["vitals"], x["meds"]))
        return scores.sofa(events).select(*SOFA_COLUMNS)

    mark = t.events.agg(F.percentile_approx("ts", 0.99).alias("mark")).first()["mark"]
    mark = F.lit(mark)
    first = compute({name: x.filter(F.col("event_ts") <= mark) for name, x in tables.items()})
    path = f"{checkpoint_dir(t.spark)}/refreshed/{uuid.uuid4().hex}"
    write_keyed(first, path, "account_id", 16)
    refresh(path, touched(tables, mark), tables, compute, buckets=16)
    return t.spark.read.schema(first.schema).parquet(path).select(*first.columns)


@query("sofa_organs", f"WITH {SQL_SLIDING} SELECT * FROM organs")
def sofa_organs(t: Tables):
    return scores.organ_rows(scores.sofa(sofa_events(t)))


@query("sofa_anchored", f"WITH {SQL_ANCHORED} SELECT {', '.join(SOFA_COLUMNS)} FROM sofa")
def sofa_anchored(t: Tables):
    return scores.sofa(sofa_events(t), anchors(t)).select(*SOFA_COLUMNS)


@query(
    "encounter_worst",
    f"""WITH {SQL_EVENTS},
windows AS (
  SELECT account_id, min(us) AS start_us, max(us) AS end_us, '' AS window_mode
  FROM scored GROUP BY 1
), {SQL_SOFA}
SELECT * FROM organs""",
)
def encounter_worst(t: Tables):
    events = scores.organ_events(c.reading_labs(t), c.reading_vitals(t), c.meds(t))
    return scores.organ_rows(scores.encounter_scores(events))


def _values(table: dict) -> str:
    rows = []
    for i, (organ, name) in enumerate(ORGAN_NAMES.items()):
        for score, text in table[organ].items():
            rows.append(f"('{organ}', {i + 1}, '{name}', {score}, '{text}')")
    return ", ".join(rows)


SQL_CRITERIA = f"""
criteria AS (
  SELECT * FROM (VALUES {_values(SOFA_CRITERIA)}) v(organ, ord, organ_name, score, criterion)
)"""

SQL_LABEL = """CASE window_mode WHEN 'poa_anchored_admission' THEN 'POA-anchored to admission'
  WHEN 'poa_anchored_first_dx' THEN 'POA-anchored to first sepsis dx' ELSE 'best 24h window' END"""


@query(
    "score_table_text",
    f"""WITH {SQL_ANCHORED}, {SQL_CRITERIA},
lines AS (
  SELECT account_id, string_agg('| ' || organ_name || ' | ' || score || ' | ' || value || ' | '
    || criterion || ' |', chr(10) ORDER BY ord) AS body
  FROM organs JOIN criteria USING (organ, score) WHERE score > 0 GROUP BY account_id
)
SELECT account_id, CASE WHEN total_score < 2 THEN 'SOFA score below 2 or unavailable.' ELSE
  'SOFA SCORES (calculated from raw clinical data):' || chr(10) || '24-hour scoring window ('
  || {SQL_LABEL} || '): ' || window_start || ' to ' || window_end || chr(10) || chr(10)
  || '| Organ System | Score | Value | Criteria |' || chr(10) || '|---|---|---|---|'
  || coalesce(chr(10) || body, '') || chr(10) || '| **TOTAL** | **' || total_score || '** | '
  || organs_scored || ' organs scored | |' || chr(10)
  || coalesce(chr(10) || 'Vasopressors administered: ' || vasopressors, '') END AS scores_text
FROM sofa LEFT JOIN lines USING (account_id)""",
)
def score_table_text(t: Tables):
    return report.sofa_text(scores.sofa(sofa_events(t), anchors(t)))


@query(
    "report_rows",
    f"""WITH {SQL_ANCHORED}, {SQL_CRITERIA},
cases AS (SELECT DISTINCT user_id AS account_id FROM events)
SELECT c.account_id, 'status_note' AS section, 0 AS ord, 'SOFA Table: ' AS c1,
  CASE WHEN s.account_id IS NULL THEN '{report.SOFA_NOTE_NO_DATA}'
    ELSE 'Not included — total SOFA score is ' || total_score || ' (below threshold of 2). '
      || organs_scored || ' organ system(s) scored.' END AS c2,
  '' AS c3, '' AS c4, '' AS c5, '' AS c6, false AS highlight
FROM cases c LEFT JOIN sofa s USING (account_id) WHERE coalesce(total_score, 0) < 2
UNION ALL
SELECT account_id, 'window', 0, 'Scoring Window (' || {SQL_LABEL} || '): ',
  window_start || ' to ' || window_end, '', '', '', '', false FROM sofa WHERE total_score >= 2
UNION ALL
SELECT account_id, 'organ', ord, organ_name, CAST(score AS VARCHAR), value, criterion, '', '', false
FROM organs JOIN criteria USING (organ, score)
WHERE score > 0 AND account_id IN (SELECT account_id FROM sofa WHERE total_score >= 2)
UNION ALL
SELECT account_id, 'total', 99, 'TOTAL', CAST(total_score AS VARCHAR),
  organs_scored || ' organs scored', '', '', '', true FROM sofa WHERE total_score >= 2""",
)
def report_rows(t: Tables):
    return report.sofa_report(cases(t), scores.sofa(sofa_events(t), anchors(t)))


# --- cross-check ------------------------------------------------------------------------------

CLAIM_NAMES = {
    "click": "PLT ", "view": "Total Bilirubin", "signup": "gcs", "purchase": "MAP",
    "error": "unknown thing",
}
SQL_CLAIMS = f"""
claims AS (
  SELECT user_id AS account_id, event_id, category, parameter,
         CASE event_id % 3 WHEN 0 THEN v WHEN 1 THEN v * 1.05 ELSE v * 1.25 END AS claimed,
         claim_time, claim_us
  FROM (
    SELECT *, CASE event_type WHEN 'click' THEN 'platelets' WHEN 'view' THEN 'bilirubin'
                WHEN 'signup' THEN 'gcs' WHEN 'purchase' THEN 'map' END AS category,
      CASE event_type WHEN 'click' THEN 'plt' WHEN 'view' THEN 'total bilirubin'
                WHEN 'signup' THEN 'gcs' WHEN 'purchase' THEN 'map' END AS parameter,
      CASE event_type WHEN 'view' THEN value / 25
        WHEN 'signup' THEN CAST(3 + CAST(trunc(value) AS INTEGER) % 13 AS DOUBLE)
        ELSE value END AS v,
      CASE event_id % 5 WHEN 0 THEN strftime(ts, '%m/%d/%Y %H:%M') WHEN 1 THEN
        strftime(ts, '%m/%d/%Y') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M')
        WHEN 3 THEN strftime(ts, '%Y-%m-%d') ELSE 'unknown' END AS claim_time,
      CASE event_id % 5 WHEN 0 THEN epoch_us(date_trunc('minute', ts))
        WHEN 1 THEN epoch_us(date_trunc('day', ts)) WHEN 2 THEN epoch_us(date_trunc('minute', ts))
        WHEN 3 THEN epoch_us(date_trunc('day', ts)) END AS claim_us
    FROM events)
  WHERE category IS NOT NULL AND claim_us IS NOT NULL
),
checked AS (
  SELECT c.account_id, c.event_id, c.parameter, c.claimed, c.claim_time, c.category,
         r.value AS raw_value, strftime(make_timestamp(r.us), '%Y-%m-%d %H:%M:%S') AS raw_time,
         CASE WHEN c.category = 'gcs' THEN trunc(c.claimed) <> trunc(r.value)
              WHEN r.value = 0 THEN abs(c.claimed) > 0.10
              ELSE abs(c.claimed - r.value) / abs(r.value) > 0.10 END AS is_mismatch
  FROM claims c JOIN readings r ON r.account_id = c.account_id AND r.category = c.category
  QUALIFY row_number() OVER (PARTITION BY c.event_id
    ORDER BY abs(c.claim_us - r.us), r.us, r.value) = 1
)"""


def claims(t: Tables):
    """Every event stated again, with its value off by 0, 5 or 25 percent."""
    names = F.create_map(*[F.lit(x) for pair in CLAIM_NAMES.items() for x in pair])
    v = F.col("value")
    true_value = (
        F.when(F.col("event_type") == "view", v / 25)
        .when(F.col("event_type") == "signup", (3 + v.cast("int") % 13).cast("double"))
        .otherwise(v)
    )
    kind = F.pmod("event_id", F.lit(3))
    stated = F.when(kind == 0, true_value).when(kind == 1, true_value * 1.05).otherwise(
        true_value * 1.25
    )
    form = F.pmod("event_id", F.lit(5))
    time = (
        F.when(form == 0, F.date_format("ts", "MM/dd/yyyy HH:mm"))
        .when(form == 1, F.date_format("ts", "MM/dd/yyyy"))
        .when(form == 2, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .when(form == 3, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise("unknown")
    )
    return t.events.select(
        F.col("user_id").alias("account_id"),
        "event_id",
        F.try_element_at(names, F.col("event_type")).alias("parameter"),
        stated.cast("string").alias("value"),
        time.alias("timestamp"),
    )


def checked(t: Tables):
    raw = scores.readings(c.reading_labs(t), c.reading_vitals(t), SEPSIS)
    return crosscheck.checked_claims(claims(t), raw, SEPSIS)


@query("numeric_crosscheck", f"WITH {c.SQL_READINGS}, {SQL_CLAIMS} SELECT * FROM checked")
def numeric_crosscheck(t: Tables):
    return checked(t)


SQL_REPLIES = """
stated AS (
  SELECT conv_id AS account_id, turn,
         [x for x in list_transform(string_split(text, chr(10)), lambda l: trim(l)) if x <> '']
           AS lines
  FROM conversations
)"""


@query(
    "numeric_mismatches",
    f"""WITH {c.SQL_READINGS}, {SQL_CLAIMS}
SELECT account_id, event_id, 'NUMERIC MISMATCH: ' || parameter || ' - Notes claim '
  || CAST(claimed AS VARCHAR) || ' (at ' || claim_time || '), but raw data shows '
  || CAST(raw_value AS VARCHAR) || ' (at ' || raw_time || ')' AS message
FROM checked WHERE is_mismatch""",
)
def numeric_mismatches(t: Tables):
    return crosscheck.mismatches(checked(t)).select("account_id", "event_id", "message")


@query(
    "merged_conflicts",
    f"""WITH {c.SQL_READINGS}, {SQL_CLAIMS}
, told AS (
  SELECT conv_id, list_filter(list_transform(string_split(text, chr(10)),
      lambda x: trim('CONFLICT ' || turn || ': ' || x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')),
    lambda x: regexp_matches(x, '^CONFLICT [0-9]+: *[^ ]')) AS lines
  FROM conversations WHERE text IS NOT NULL
)
SELECT conv_id AS account_id, 'reply' AS origin, CAST(i - 1 AS DOUBLE) AS position, lines[i] AS conflict
FROM (SELECT conv_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM told)
UNION ALL
SELECT account_id, 'numeric', NULL, 'NUMERIC MISMATCH: ' || parameter || ' - Notes claim '
  || CAST(claimed AS VARCHAR) || ' (at ' || claim_time || '), but raw data shows '
  || CAST(raw_value AS VARCHAR) || ' (at ' || raw_time || ')'
FROM checked WHERE is_mismatch""",
)
def merged_conflicts(t: Tables):
    # every line of a turn stands as a conflict of the turn's number
    mark = F.concat(F.lit("CONFLICT "), F.col("turn").cast("string"), F.lit(": "))
    reply = F.concat(mark, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), mark)))
    stated = crosscheck.conflict_lines(
        t.conversations.select(F.col("conv_id").alias("account_id"), reply.alias("reply"))
    )
    rows = crosscheck.merged_conflicts(stated, crosscheck.mismatches(checked(t)))
    return rows.withColumn("position", F.col("position").cast("double"))


@query(
    "score_rows",
    f"""WITH {SQL_ANCHORED},
cases AS (SELECT c_custkey AS account_id FROM customer)
SELECT account_id, coalesce(total_score, 0) AS total_score, coalesce(organs_scored, 0)
  AS organs_scored, coalesce(body, '{{}}') AS organ_scores, vasopressors, window_start, window_end,
  coalesce(window_mode, 'sliding_best_score') AS window_mode
FROM cases LEFT JOIN sofa USING (account_id)
LEFT JOIN (SELECT account_id, '{{' || string_agg('"' || organ || '":{{"score":' || score
    || ',"value":"' || value || '","timestamp":"' || timestamp || '"}}', ','
    ORDER BY organ = 'cardiovascular', organ) || '}}' AS body FROM organs GROUP BY 1)
  USING (account_id)""",
)
def score_rows(t: Tables):
    """Customers are the cases; most have nothing to score and get the empty row."""
    cases_ = t.customer.select(F.col("c_custkey").alias("account_id"))
    rows = scores.sofa(sofa_events(t), anchors(t))
    return scores.score_rows(cases_, rows, F.current_timestamp()).drop("created_at")


# --- rules by the thousand --------------------------------------------------------------------


@query(
    "name_rules",
    """WITH rules AS (
  SELECT p_partkey AS category, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS word,
         CASE WHEN p_size > 25 THEN 'machinery' END AS exclude FROM part
)
SELECT c_custkey AS account_id, category FROM customer JOIN rules
  ON contains(lower(c_name || ' ' || c_mktsegment), word)
WHERE exclude IS NULL OR NOT contains(lower(c_name || ' ' || c_mktsegment), exclude)""",
)
def name_rules(t: Tables):
    number = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    rules = t.part.select(
        F.col("p_partkey").alias("category"),
        F.col("p_partkey").alias("place"),
        F.explode(
            F.array(
                F.struct(number.alias("word"), F.lit(False).alias("excludes")),
                F.struct(F.when(F.col("p_size") > 25, "machinery").alias("word"), F.lit(True).alias("excludes")),
            )
        ).alias("rule"),
    ).select("category", "place", "rule.*")
    names = t.customer.select(
        F.col("c_custkey").alias("account_id"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("name")
    )
    return matchers.with_categories(names, "name", rules).select("account_id", "category")
