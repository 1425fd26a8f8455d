import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators import crosscheck, report, scores
from caseflow.profiles import RESPIRATORY_FAILURE, SEPSIS
from tests import models

HOUR = 3_600_000_000
DAY = 24 * HOUR
EVENT = "account_id long, us long, organ string, score int, value double, display string, drug string, dose double"


def events(spark, rows):
    full = [(a, us, o, s, v, str(v) if d is None else d, d, x) for a, us, o, s, v, d, x in rows]
    return spark.createDataFrame(full, EVENT)


def random_events(seed, accounts=6, n=25, span=5 * 24):
    rnd = random.Random(seed)
    rows, seen = [], set()
    for a in range(accounts):
        for _ in range(n):
            us = rnd.randint(0, span) * HOUR
            kind = rnd.choice(scores.ORGANS + ("vasopressor",))
            drug = dose = None
            if kind == "vasopressor":
                drug = rnd.choice(["dopamine", "norepinephrine", "dobutamine", "vasopressin"])
                dose = rnd.choice([None, 0.05, 0.5, 7.0, 20.0])
                score = models.points(drug, dose)
            else:
                score = rnd.randint(0, 1 if kind == "cardiovascular" else 4)
            if (a, us, kind, drug) in seen:
                continue
            seen.add((a, us, kind, drug))
            rows.append((a, us, kind, score, float(score), drug, dose))
    return rows


@pytest.mark.parametrize("seed,width", [(1, HOUR), (2, 7 * HOUR), (3, 100 * DAY)])
def test_sliding_score_equals_the_model(spark, seed, width):
    rows = random_events(seed)
    out = {r.account_id: r for r in scores.sofa(events(spark, rows), width_us=width).collect()}
    for a in {r[0] for r in rows}:
        mine = [(us, o, s, v, d, x) for acc, us, o, s, v, d, x in rows if acc == a]
        total, start, organs = models.best_window(mine)
        got = out[a]
        assert (got.total_score, got.organs_scored) == (total, len(organs))
        assert {o.organ: o.score for o in got.organs} == {k: v[0] for k, v in organs.items()}
        times = {o.organ: o.us for o in got.organs if o.organ != "cardiovascular"}
        assert times == {k: v[1] for k, v in organs.items() if k != "cardiovascular"}
        assert got.window_mode == "sliding_best_score"
        assert got.window_start.startswith("1970-01")


def test_dense_slices_give_the_same_windows(spark):
    rows = [(1, us % (2 * HOUR) if us % 3 else us, *rest) for _, us, *rest in random_events(4)]
    whole = scores.best_windows(events(spark, rows)).collect()
    assert scores.best_windows(events(spark, rows), dense_rows=5).collect() == whole


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_slices_of_best_windows_share_a_shuffle(spark):
    best = scores.best_windows(events(spark, random_events(6)))
    assert best.count() == 6 and len(best.collect()) == 6
    final = plan(best).split("Initial Plan")[0].splitlines()
    assert any("ReusedExchange" in line and "REPARTITION_BY_COL" in line for line in final)


def test_a_value_is_read_once(spark):
    ids = spark.range(6)
    at = F.when(F.col("id") != 2, F.timestamp_seconds("id"))
    text = F.element_at(F.array(*[F.lit(x) for x in ("<7", "1,200", "5", "none", "NaN", "3")]), (F.col("id") + 1).cast("int"))
    labs = ids.select(F.lit(1).alias("account_id"), at.alias("event_ts"), F.lit("PO2 ART").alias("lab_name"), text.alias("lab_value"))
    vitals = ids.select(F.lit(1).alias("account_id"), at.alias("event_ts"), F.lit("MAP").alias("vital_name"), text.alias("vital_value"))
    out = scores.readings(labs, vitals, SEPSIS)
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, us, kind, v) for us, v in ((0, 7.0), (10**6, 1200.0), (5 * 10**6, 3.0)) for kind in ("map", "pao2")
    ]
    # once for the labs and once for the vitals, not in a filter as well
    assert plan(out).count("RLIKE") == 2


def test_window_is_closed_at_both_ends(spark):
    rows = [
        (1, 0, "renal", 1, 1.0, None, None), (1, DAY, "liver", 4, 4.0, None, None),
        (2, 0, "renal", 1, 1.0, None, None), (2, DAY + 1, "liver", 4, 4.0, None, None),
    ]
    out = {r.account_id: r.total_score for r in scores.sofa(events(spark, rows)).collect()}
    assert out == {1: 5, 2: 4}


def test_pressure_alone_at_zero_is_absent_and_drugs_beat_it(spark):
    rows = [
        (1, 0, "cardiovascular", 0, 80.0, None, None),
        (2, 0, "cardiovascular", 1, 60.0, None, None), (2, 1, "vasopressor", 3, None, "norepinephrine", None),
        (2, 2, "vasopressor", 3, 0.05, "epinephrine", 0.05),
        (3, 0, "vasopressor", 3, None, "norepinephrine", None),
        (3, 5, "vasopressor", 4, 0.3, "norepinephrine", 0.3),
        (3, 9, "vasopressor", 4, 0.3, "norepinephrine", 0.3),
    ]
    out = {r.account_id: r for r in scores.sofa(events(spark, rows)).collect()}
    assert out[1].organs == [] and out[1].total_score == 0 and out[1].organs_scored == 0
    # equal points: the drug given first
    assert [(o.organ, o.score, o.value) for o in out[2].organs] == [("cardiovascular", 3, "norepinephrine")]
    assert out[2].vasopressors == "epinephrine, norepinephrine"
    # the highest dose, when it was first reached
    assert [(o.score, o.us) for o in out[3].organs] == [(4, 5)]


def test_anchors_decide_the_window(spark):
    rows = [(a, h * HOUR, "renal", s, float(s), None, None) for a in range(1, 6) for h, s in ((10, 1), (100, 4))]
    ts = F.timestamp_micros
    anchors = spark.createDataFrame(
        [(1, 0, 1, 99), (2, 0, 2, 99), (3, 0, 3, 99), (4, None, 1, 99), (5, 500, 1, 99)],
        "account_id long, a long, poa_code int, d long",
    ).select(
        "account_id",
        ts(F.col("a") * HOUR).alias("admit_ts"),
        "poa_code",
        ts(F.col("d") * HOUR).alias("first_dx_ts"),
    )
    out = {r.account_id: r for r in scores.sofa(events(spark, rows), anchors).collect()}
    assert [(out[a].total_score, out[a].window_mode) for a in range(1, 6)] == [
        (1, "poa_anchored_admission"),
        (4, "poa_anchored_first_dx"),
        (4, "sliding_best_score"),
        (4, "sliding_best_score"),
        (0, "poa_anchored_admission"),  # nothing inside: the row stays
    ]


def test_all_of_one_account(spark):
    """An account that owns all rows, far more than others, spread over its slices."""
    rows = random_events(9, accounts=1, n=400, span=60 * 24)
    total, start, _ = models.best_window([r[1:] for r in rows])
    got = scores.sofa(events(spark, rows)).first()
    assert got.total_score == total


def test_drug_points(spark):
    cases = [("dopamine", 15.1), ("dopamine", 15.0), ("dopamine", 5.0), ("dopamine", None), ("dobutamine", 99.0),
             ("epinephrine", 0.1), ("epinephrine", 0.11), ("norepinephrine", None), ("vasopressin", 9.0)]
    frame = spark.createDataFrame(cases, "drug string, dose double")
    got = [r.p for r in frame.select(scores.drug_points(F.col("drug"), F.col("dose")).alias("p")).collect()]
    assert got == [models.points(*c) for c in cases]


def lab_frames(spark, labs, vitals):
    ts = F.timestamp_seconds("t").alias("event_ts")
    lab = spark.createDataFrame(labs, "account_id long, t long, lab_name string, lab_value string")
    vit = spark.createDataFrame(vitals, "account_id long, t long, vital_name string, vital_value string")
    return (lab.select("account_id", ts, "lab_name", "lab_value"),
            vit.select("account_id", ts, "vital_name", "vital_value"))


def test_ratio_series(spark):
    labs, vitals = lab_frames(
        spark,
        [(1, 0, "PO2 ART", "80"), (1, 1800, "FIO2", "40"), (1, 10000, "pO2", "90"), (1, 11801, "FiO2", "0.5"),
         (1, 20000, "PaO2", "100"), (1, 20010, "FIO2", "0"), (1, 20020, "FIO2", "1.0"), (2, 0, "PO2", "60"),
         (1, 30000, "Venous PO2", "50"), (1, 30000, "FIO2", "50")],
        [(1, 7200, "PEEP", "5"), (1, 20000 + 7201, "Total PEEP", "9")],
    )
    rows = scores.pf_series(labs, vitals).orderBy("position").collect()
    assert [(r.pao2, r.fio2_raw, r.ratio, r.classification, r.peep) for r in rows] == [
        (80.0, 40.0, 200.0, "Moderate ARDS", 5.0),
        (100.0, 1.0, 100.0, "Severe ARDS", None),
    ]
    assert [r.position for r in rows] == [0, 1]
    summary = scores.pf_summary(scores.pf_series(labs, vitals)).first()
    assert (summary.worst_ratio, summary.measurements_calculated, summary.n_qualifying) == (100.0, 2, 2)


def test_ratio_text_continues_over_parts(spark):
    n = 12
    labs, vitals = lab_frames(
        spark,
        [(1, i * 3600, "PO2", "80") for i in range(n)] + [(1, i * 3600, "FIO2", "50") for i in range(n)],
        [],
    )
    series = scores.pf_series(labs, vitals)
    whole = report.pf_text(series, scores.pf_summary(series), RESPIRATORY_FAILURE).collect()
    parts = report.pf_text(series, scores.pf_summary(series), RESPIRATORY_FAILURE, part_chars=200)
    rows = sorted(parts.collect(), key=lambda r: r.part_no)
    assert len(whole) == 1 and len(rows) > 2
    assert "\n".join(r.scores_text for r in rows) == whole[0].scores_text


def test_small_numbers_are_not_shown_as_powers(spark):
    labs = spark.sql("SELECT 1 account_id, timestamp'2024-01-01' event_ts, 'Creatinine' lab_name, '0.0004' lab_value")
    vitals = spark.sql("SELECT 1 account_id, timestamp'2024-01-01' event_ts, 'MAP' vital_name, '0.00005' vital_value")
    meds = spark.sql("SELECT 1 account_id, timestamp'2024-01-01' event_ts, 'Epinephrine' med_name, '0.0002' med_dose")
    shown = {r.organ: r.display for r in scores.organ_events(labs, vitals, meds).collect()}
    assert shown == {"renal": "0.0004", "cardiovascular": "MAP = 5e-05", "vasopressor": "epinephrine 0.0002"}
    checked = spark.sql("SELECT 'plt' parameter, 0.0005D claimed, 'then' claim_time, 0.0004D raw_value, 'now' raw_time, true is_mismatch")
    message = "NUMERIC MISMATCH: plt - Notes claim 0.0005 (at then), but raw data shows 0.0004 (at now)"
    assert crosscheck.mismatches(checked).first().message == message


def test_organ_events_end_to_end(spark):
    labs, vitals = lab_frames(
        spark,
        [(1, 0, "Platelet Count", "<90"), (1, 0, "Creatinine", "2.5"), (1, 0, "Creatinine Urine", "9"),
         (1, 0, "PO2", "50"), (1, 999999, "FIO2", "50")],
        [(1, 0, "MAP", "60"), (1, 0, "Glasgow Coma Scale", "14.5"), (1, 0, "GCS eye", "1")],
    )
    meds = spark.createDataFrame(
        [(1, 0, "Norepinephrine drip", "0.05"), (1, None, "Dopamine", "20")],
        "account_id long, t long, med_name string, med_dose string",
    ).select("account_id", F.timestamp_seconds("t").alias("event_ts"), "med_name", "med_dose")
    row = scores.sofa(scores.organ_events(labs, vitals, meds)).first()
    assert {o.organ: (o.score, o.value) for o in row.organs} == {
        "coagulation": (2, "90.0"), "renal": (2, "2.5"), "respiratory": (3, "PaO2/FiO2 = 100.0"),
        "cns": (1, "GCS = 14"), "cardiovascular": (3, "norepinephrine 0.05"),
    }
    text = report.sofa_text(scores.sofa(scores.organ_events(labs, vitals, meds))).first().scores_text
    assert "| **TOTAL** | **11** | 5 organs scored | |" in text and text.endswith("norepinephrine")
    low = report.sofa_text(scores.sofa(scores.organ_events(labs.filter("lab_name = 'x'"), vitals.filter("vital_name = 'MAP'"), meds.filter("med_name = 'x'")))).first()
    assert low.scores_text == report.NO_SOFA


def test_rule_tables_say_what_columns_say(spark):
    from caseflow.functions.values import Matcher, categories
    from caseflow.operators import matchers as tables

    rules = {
        "a": Matcher(("lact", "ph"), ("dehydrogenase",)),
        "b": Matcher(("gluc",), kind="vital"),
        "c": Matcher(("p", "ph arterial"), ("lympho",)),
        "d": Matcher(("arterial",)),
    }
    names = ["Lactate", "LACTATE dehydrogenase", "pH Arterial", "Lymphocytes", "P", "", None, "gluc", "alpha ph", "x"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names * 2)], "i long, name string")
    for whole_word in (False, True):
        for kind in (None, "lab"):
            for exclusive in ((), ("c", "d")):
                want = rows.select("i", F.explode(categories(F.col("name"), rules, kind, whole_word, exclusive)).alias("category"))
                found = tables.with_categories(rows, "name", tables.rules_of(spark, rules, kind), whole_word, exclusive)
                assert sorted((r.i, r.category) for r in found.collect()) == sorted(
                    (r.i, r.category) for r in want.filter("category is not null").collect()
                )


def test_ten_thousand_rules(spark):
    from caseflow.operators import matchers as tables

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(1, 8)))
    rules = [(f"c{i}", i, word(), r.random() < 0.2) for i in range(10_000)] + [("c1", 1, None, False), ("e", 0, "", False)]
    names = [word() + " " + word() for _ in range(150)]
    found = tables.named_categories(
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame(rules, "category string, place int, word string, excludes boolean"),
    )
    want = set()
    for n in set(names):
        held = [(c, out) for c, _, w, out in rules if w is not None and w in n]
        want |= {(n, c) for c in {c for c, out in held if not out} - {c for c, out in held if out}}
    assert {tuple(x) for x in found.collect()} == want


def test_categories_of_the_same_rules_are_one_set(spark):
    """A word that all names hold and all categories exclude does not bring each name each category."""
    from caseflow.operators import matchers as tables

    rules = [(c, c, word, out) for c in range(60) for word, out in ((f"w{c % 3}", False), ("common", True) if c % 2 else (None, True))]
    rules = spark.createDataFrame(rules, "category int, place int, word string, excludes boolean")
    names = spark.createDataFrame([(f"w{i % 4} {'common' if i % 5 else 'rare'} {i}",) for i in range(40)], "name string")
    sets, members = tables._rule_sets(rules)
    assert sets.count() == 6 and members.count() == 60
    met = tables._named_sets(names, sets, False)
    assert met.count() == sum((i % 4 < 3) * (1 if i % 5 else 2) for i in range(40))
    found = {(r.name, r.category) for r in tables.with_categories(names, "name", rules).collect()}
    assert found == {
        (n.name, c) for n in names.collect() for c in range(60) if f"w{c % 3}" in n.name and not (c % 2 and "common" in n.name)
    }
