from datetime import datetime

from pyspark.sql import functions as F

from caseflow import schemas
from caseflow.operators import crosscheck, extract, notes, timeline
from caseflow.operators.textparts import json_parts, text_parts
from caseflow.profiles import SEPSIS
from caseflow.schemas import records

T0, T1 = datetime(2024, 1, 1, 8), datetime(2024, 1, 2, 9)


def test_timeline_drops_copies_and_keeps_the_abnormal_one(spark):
    labs = records(
        spark,
        [
            (1, 1, T0, "Na", "140", "mmol", None), (1, 1, T0, "Na", "140", "mmol", None),
            (1, 1, T0, None, "3", None, None), (1, 1, T0, None, "4", None, "High"),
            (1, 1, T1, "K", "9", None, "High"),
        ],
        schemas.LABS,
    )
    out = timeline.merge_timeline(timeline.lab_events(labs)).collect()
    # a null name makes a null detail; such rows fall together
    assert {(r.event_detail, r.is_abnormal) for r in out} == {
        ("Na: 140 mmol", 0), (None, 1), ("K: 9  (High)", 1),
    }


def test_event_details(spark):
    meds = records(spark, [(1, 1, T0, "Drug", None, None, None, "Given")], schemas.MEDS)
    assert timeline.med_events(meds).first().event_detail == "Drug   via unknown - Given"
    dx = records(
        spark,
        [(1, 1, 1, "name", "A1", T0, "s", None), (1, 1, 1, None, "A1", T0, "s", None),
         (1, 1, 1, "name", None, T0, "s", None), (1, 1, 1, "late", "A2", None, "s", None)],
        schemas.DIAGNOSES,
    )
    assert [r.event_detail for r in timeline.diagnosis_events(dx).collect()] == [
        "A1 - name", "A1Unknown diagnosis", "name",
    ]


def test_timeline_text_cap(spark):
    rows = [(1, 1, datetime(2024, 1, 1, 0, i), "LAB", f"d{i}", i % 2) for i in range(9)]
    text = timeline.timeline_text(records(spark, rows, schemas.TIMELINE), max_events=3).first()
    assert text.n_events == 3
    assert text.timeline_text == (
        "[2024-01-01 00:00:00] LAB: d0\n[2024-01-01 00:01:00] LAB: d1 (ABNORMAL)\n"
        "[2024-01-01 00:02:00] LAB: d2"
    )


def test_timeline_text_is_whole(spark):
    rows = [(1, 1, datetime(2024, 1, 1, i // 60, i % 60), "LAB", f"d{i}", 0) for i in range(700)]
    events = records(spark, rows, schemas.TIMELINE)
    accounts = spark.createDataFrame([(1,), (2,)], "account_id long")
    out = {r.account_id: r for r in timeline.timeline_text(events, accounts).collect()}
    assert out[1].n_events == 700 and out[1].timeline_text.count("\n") == 699
    assert out[2].timeline_text == timeline.NO_TIMELINE and out[2].n_events == 0
    parts = timeline.timeline_text(events, part_chars=500).orderBy("part_no").collect()
    assert len(parts) > 20 and "\n".join(p.timeline_text for p in parts) == out[1].timeline_text


def test_sectioned_timeline(spark):
    enc = records(spark, [(1, 2, 3, T0, None)], schemas.ENCOUNTERS)
    dx = spark.createDataFrame(
        [(1, 2, "A1", None, "BEFORE", "x", T0, "S"), (1, 2, "A2", "n", "DURING", "x", T1, "S"),
         (1, 9, "A3", "n", "BEFORE", "x", T0, "S")],
        "account_id long, encounter_id long, icd10_code string, icd10_description string, "
        "timing_category string, availability_time string, event_ts timestamp, source string",
    )
    events = timeline.merge_timeline(timeline.during_diagnosis_events(dx))
    rows = timeline.sections_in_order(timeline.sectioned_timeline(enc, dx, events)).collect()
    ordered = extract.timings_in_order(dx).collect()
    assert [r.icd10_code for r in ordered] == ["A2", "A1", "A3"]
    assert [r.content for r in rows] == [
        "Account ID: 1\nEncounter: 2\nAdmission: 2024-01-01 08:00:00\nDischarge: Still admitted",
        "A1: Unknown (S)",
        "[2024-01-02 09:00:00] DIAGNOSIS: A2 - n (S)",
    ]


def test_lab_rules(spark):
    enc = records(spark, [(1, 10, 5, T0, None), (2, 20, 6, T0, None)], schemas.ENCOUNTERS)
    cases = spark.createDataFrame([(1,)], "account_id long")
    orders = spark.createDataFrame(
        [(10, 100, 5, 3), (10, 101, 5, 1), (10, 102, 2, 3), (20, 103, 5, 5)],
        "encounter_id long, order_id long, order_status int, lab_status int",
    )
    results = spark.createDataFrame(
        [(100, 7, 9), (101, 8, 9), (102, 9, 9), (103, 6, 9)],
        "order_id long, result_id long, result_status int",
    )
    comps = spark.createDataFrame(
        [(7, 1, ">12", "u", 1, T0), (7, 1, "-1", "u", 1, T0), (7, 1, None, "u", 1, T0),
         (7, 2, "3", None, None, T1), (6, 1, "4", None, None, T1)],
        "result_id long, component_id long, value string, units string, abnormal_code int, verified_ts timestamp",
    )
    names = spark.createDataFrame([(1, "Na"), (2, "K")], "component_id long, lab_name string")
    flags = spark.createDataFrame([(1, "High")], "abnormal_code int, abnormal_flag string")
    out = extract.labs(extract.target_encounters(enc, cases), orders, results, comps, names, flags)
    assert sorted((r.lab_name, r.lab_value, r.abnormal_flag) for r in out.collect()) == [
        ("K", "3", None), ("Na", "12", "High"),
    ]


def test_poa_anchor_takes_the_earliest(spark):
    dx = records(
        spark,
        [(1, 1, 1, "Sepsis", "A41", T1, "INPATIENT_ACCT_DX", 1), (1, 1, 1, None, "R65.20", T0, "INPATIENT_ACCT_DX", 2),
         (1, 1, 1, None, "R65.20", datetime(2020, 1, 1), "INPATIENT_ACCT_DX", None),
         (1, 1, 1, None, "R65.20", datetime(2020, 1, 1), "PROBLEM_LIST", 1), (2, 1, 1, "x", "y", T0, "INPATIENT_ACCT_DX", 1)],
        schemas.DIAGNOSES,
    )
    rows = extract.poa_anchor(dx, SEPSIS.poa_predicate).collect()
    assert [(r.account_id, r.poa_code, r.first_dx_ts) for r in rows] == [(1, 2, T0)]


def test_same_account_only(spark):
    enc = records(spark, [(1, 10, 5, T0, None)], schemas.ENCOUNTERS)
    tables = {
        "encounter_dx": spark.createDataFrame([], "encounter_id long, dx_id long, icd10_code string"),
        "contacts": spark.createDataFrame([], "encounter_id long, contact_date timestamp"),
        "account_dx": spark.createDataFrame(
            [(5, 1, 7, "A", 1), (5, 2, 8, "B", 1)],
            "patient_id long, account_id long, dx_id long, icd10_code string, poa_code int",
        ),
        "discharges": spark.createDataFrame([(1, T0), (2, T1)], "account_id long, discharge_ts timestamp"),
        "problems": spark.createDataFrame(
            [], "patient_id long, problem_id long, problem_name string, problem_icd10_code string, "
            "entry_date timestamp, status string",
        ),
        "dictionary": spark.createDataFrame([(7, "x")], "dx_id long, dx_name string"),
    }
    both = extract.diagnoses(enc, **tables).collect()
    own = extract.diagnoses(enc, **tables, same_account_only=True).collect()
    assert sorted(r.icd10_code for r in both) == ["A", "B"] and [r.icd10_code for r in own] == ["A"]


def test_facility(spark):
    row = spark.range(1).select(extract.facility_of(F.lit("PARENT  NORTH hospital ")).alias("x"))
    assert row.first().x == "North Hospital"


def test_parts_join_to_the_whole(spark):
    rows = [(k, i, f"line {i}" if i % 5 else None) for k in (1, 2) for i in range(100)]
    frame = spark.createDataFrame(rows, "k int, i long, t string")
    def parts(n, width):
        return text_parts(frame, ["k"], F.col("t"), "\n", F.col("i"), (), n, width).collect()
    whole = {r.k: r.text for r in parts(10**6, 7)}
    assert whole[1] == "\n".join(f"line {i}" for i in range(100) if i % 5)
    for n, width in ((50, 7), (50, 1000), (333, 3)):
        cut = sorted(parts(n, width), key=lambda r: (r.k, r.part_no))
        assert max(len(r.text) for r in cut) <= n + 10
        for k in (1, 2):
            assert "\n".join(r.text for r in cut if r.k == k) == whole[k]


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_only_long_texts_are_placed_by_slices(spark):
    sizes = {1: 3, 2: 200, 3: 40, None: 90}  # keys of one part and of several, a null key among the latter
    rows = [(k, i, f"line {i}") for k, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "k int, i long, t string")
    out = {}
    for r in text_parts(frame, ["k"], F.col("t"), "\n", F.col("i"), (), 400, 7).orderBy("part_no").collect():
        out.setdefault(r.k, []).append(r)
    for k, n in sizes.items():
        assert "\n".join(r.text for r in out[k]) == "\n".join(f"line {i}" for i in range(n))
        assert sum(r.n_rows for r in out[k]) == n and [r.part_no for r in out[k]] == list(range(len(out[k])))
    assert {k for k, parts in out.items() if len(parts) == 1} == {1, 3}
    plan = _plan(text_parts(frame, ["k"], F.col("t"), "\n", F.col("i"), (), 10**6, 7))
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_capped_timeline_is_shuffled_once(spark):
    rows = [(k, 1, datetime(2024, 1, 1, 0, i), "LAB", f"d{i}", 0) for k in (1, 2) for i in range(9)]
    events = records(spark, rows, schemas.TIMELINE)
    plan = _plan(timeline.timeline_text(events, max_events=3))
    assert plan.count("Exchange hashpartitioning") == 1
    parts = timeline.timeline_text(events, max_events=5, part_chars=60).orderBy("account_id", "part_no").collect()
    assert [(p.account_id, p.part_no, p.n_events) for p in parts] == [
        (1, 0, 2), (1, 1, 2), (1, 2, 1), (2, 0, 2), (2, 1, 2), (2, 2, 1),
    ]


def test_claim_ids_are_gathered_by_account(spark):
    rows = [(k, i, f"a{i % 3}", None if i % 2 else f"b{i}", None) for k, n in ((1, 4), (2, 60)) for i in range(n)]
    claims = spark.createDataFrame(rows, "account_id int, at long, icn string, icn_no string, control_no string")
    for part_chars in (10**6, 100):
        got = {}
        lists = extract.claim_id_lists(claims, F.col("at"), 1, part_chars).orderBy("part_no")
        for r in lists.collect():
            got.setdefault((r.account_id, r.id_kind), []).append(r)
        assert set(got) == {(k, kind) for k in (1, 2) for kind in ("icn", "icn_no")}
        for (k, kind), parts in got.items():
            at = 2 if kind == "icn" else 3
            want = [r[at] for r in rows if r[0] == k and r[at] is not None]
            assert ", ".join(p.claim_ids for p in parts) == ", ".join(want)
            assert sum(p.n_rows for p in parts) == len(want)
            assert (len(parts) > 1) == (k == 2 and part_chars == 100)
    plan = _plan(extract.claim_id_lists(claims, F.col("at"), 1))
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_json_parts(spark):
    frame = spark.createDataFrame([(1, 1, "a"), (1, 2, None)], "k int, i long, name string")
    row = json_parts(frame, ["k"], F.struct("name"), F.col("i")).first()
    assert row.records == '[{"name":"a"},{}]'


NOTE = "account_id long, note_type string, note_id long, note_csn_id long, contact_date date, entry_ts timestamp, note_text string"


def test_notes_by_type_and_wide(spark):
    d0, d1 = T0.date(), T1.date()
    rows = spark.createDataFrame(
        [(1, "H&P", 2, 20, d1, T1, "second"), (1, "H&P", 1, 10, d0, None, "first"), (1, "H&P", 3, None, d1, T1, None),
         (1, "Unlisted", 9, 9, d0, T0, "never"), (2, "Query", 4, 40, d0, T0, "")],
        NOTE,
    )
    out = {(r.account_id, r.note_type): r for r in notes.notes_by_type(rows).collect()}
    assert set(out) == {(1, "H&P"), (2, "Query")}
    hp = out[1, "H&P"]
    assert hp.note_ids == "1, 2, 3" and hp.note_csn_ids == "10, 20"
    assert hp.note_text == "[2024-01-01 00:00:00]\nfirst\n\n---\n\n[2024-01-02 09:00:00]\nsecond"
    assert out[2, "Query"].note_text == "No Note Available"
    wide = {r.account_id: r for r in notes.notes_wide(notes.notes_by_type(rows)).collect()}
    assert len(wide[1]) == 2 + 3 * 47
    assert wide[1].hp_note_id == "1, 2, 3" and wide[1].query_text == "No Note Available"
    assert wide[2].hp_note_csn_id == "no id available"
    latest = notes.latest_notes(rows.filter("note_type = 'H&P'")).first()
    assert latest.note_id == 3


def test_note_gate(spark):
    frame = spark.createDataFrame(
        [(1, None, None), (2, "No Note Available", "x"), (3, "short", "x"), (4, "a long note", "found"), (5, "a long note", None)],
        "i int, t string, e string",
    )
    out = frame.select("i", notes.gate(F.col("t"), F.col("e")).alias("g")).orderBy("i").collect()
    assert [r.g for r in out] == ["Not available", "Not available", "x", "found", "a long note"]


def test_notes_sections(spark):
    frame = spark.createDataFrame(
        [(1, "nursing_note", "n"), (1, "discharge_summary", "d"), (1, "zeta", "z"), (1, "alpha", "Not available"), (2, "alpha", "")],
        "account_id long, note_key string, note_text string",
    )
    out = {r.account_id: r for r in notes.notes_section(frame).collect()}
    assert out[1].notes_section == "## Discharge Summary\nd\n\n## Nursing Note\nn\n\n## Zeta\nz"
    assert out[2].notes_section == notes.NO_NOTES and out[2].n_notes == 0
    assert notes.notes_summary(frame).first().notes_summary.startswith("## discharge_summary\nd\n\n## nursing")


def test_parts_of_notes_lose_and_repeat_nothing(spark):
    day = datetime(2024, 1, 1)
    notes_of = lambda i, n: [(1, "Query", i, 90 + i, day, day.replace(hour=i), f"{i}w{k}", k) for k in range(n)]
    lines = spark.createDataFrame(
        [*notes_of(1, 40), *notes_of(2, 50)],
        "account_id long, note_type string, note_id long, note_csn_id long, contact_date timestamp, "
        "entry_ts timestamp, note_text string, line int",
    )
    keys = ["account_id", "note_type", "note_id", "note_csn_id", "contact_date", "entry_ts"]
    texts = {}
    for size in (20, 10**6):
        parts = notes.reassemble(lines, keys, "note_text", "line", " ", size).withColumnRenamed("text", "note_text")
        latest = notes.latest_notes(parts).orderBy("part_no").collect()
        assert " ".join(r.note_text for r in latest) == " ".join(f"2w{k}" for k in range(50))
        joined = notes.notes_by_type(parts, 10**6).collect()
        assert len(joined) == 1 and joined[0].note_ids == "1, 2" and joined[0].note_text.count("[2024") == 2
        texts[size] = joined[0].note_text.replace(notes.NOTE_SEPARATOR, " ")
    assert texts[20] == texts[10**6]


def test_consumers_keep_one_row_per_account_and_part(spark):
    from caseflow.operators import report
    from caseflow.plans import case, spine
    from caseflow.profiles import SEPSIS

    parts = spark.createDataFrame([(1, k, f"t{k}") for k in range(4)] + [(2, 0, "u")], "account_id long, part_no int, note_text string")
    rows = spine.spine_features(parts.select("account_id"), parts).orderBy("account_id", "part_no").collect()
    assert [(r.account_id, r.part_no, r.note_text) for r in rows] == [*((1, k, f"t{k}") for k in range(4)), (2, 0, "u")]
    plain = lambda names: spark.createDataFrame([], "account_id long, " + ", ".join(f"{n} string" for n in names))
    denial = parts.withColumnRenamed("note_text", "denial_text").selectExpr(
        "*", "'p' payor", "'1' original_drg", "'2' proposed_drg", "true is_condition_match"
    )
    conflicts = spark.createDataFrame([], "account_id long, conflicts array<string>, recommendation string")
    cases = case.read_back(
        denial, plain(["patient_name", "patient_dob", "facility_name", "date_of_service"]),
        parts.withColumnRenamed("note_text", "structured_summary"), plain(["total_score", "organs_scored"]), conflicts,
    )
    assert cases.count() == 5 and {r.structured_summary for r in cases.collect()} == {"t0", "t1", "t2", "t3", "u"}
    more = cases.selectExpr("*", "null notes_section", "null scores_text", "null definition", "null template_letter")
    template = "{payor}: {denial_letter_text} {{x}} {structured_data_summary}; {denial_letter_text}{conditional_rebuttals_section}."
    rebuttals = spark.createDataFrame([(1, "b", "{payor}"), (1, "a", "one"), (3, "a", "none")], "account_id long, name string, text string")
    whole = {1: "p: t0|t1|t2|t3 {{x}} t0\n\nt1\n\nt2\n\nt3; t0|t1|t2|t3## a\none\n\n## b\n{payor}.", 2: "p: u {{x}} u; u."}
    for part_chars in (1, 10, 10**6):
        prompts = report.writer_context(more, template, SEPSIS, rebuttals, {"denial_text": "|"}, part_chars).orderBy("account_id", "part_no").collect()
        assert len(prompts) > 4 or part_chars > 1
        assert {a: "".join(r.prompt for r in prompts if r.account_id == a) for a in (1, 2)} == whole
        assert {r.account_id for r in prompts} == {1, 2}


def test_every_part_comes_back(spark):
    from caseflow.plans import case, spine

    parts = spark.createDataFrame([(1, k, f"t{k}") for k in range(4)] + [(2, 0, "u")], "account_id long, part_no int, note_text string")
    accounts = spark.createDataFrame([(1,), (2,), (3,)], "account_id long")
    one = spark.createDataFrame([(1, "f"), (3, "g")], "account_id long, facility string")
    rows = spine.spine_features(accounts, one, parts).collect()
    assert sorted((r.account_id, r.part_no, r.facility, r.note_text) for r in rows if r.account_id != 2) == [
        *[(1, k, "f", f"t{k}") for k in range(4)], (3, 0, "g", None)
    ]
    denial = accounts.selectExpr(
        "account_id", "'d' denial_text", "'p' payor", "'1' original_drg", "'2' proposed_drg", "true is_condition_match"
    )
    plain = lambda names: spark.createDataFrame([], "account_id long, " + ", ".join(f"{n} string" for n in names))
    longer = spark.createDataFrame([(2, k, f"c{k}") for k in range(2)], "account_id long, part_no int, recommendation string")
    cases = case.read_back(
        denial, plain(["patient_name", "patient_dob", "facility_name", "date_of_service"]),
        parts.withColumnRenamed("note_text", "structured_summary"), plain(["total_score", "organs_scored"]),
        longer.selectExpr("*", "array('x') conflicts"),
    )
    assert sorted((r.account_id, r.part_no, r.structured_summary, r.recommendation) for r in cases.collect()) == [
        *[(1, k, f"t{k}", "") for k in range(4)], (2, 0, "u", "c0"), (2, 1, "", "c1"), (3, 0, case.NO_SUMMARY, ""),
    ]
    counts = spark.createDataFrame([(1, 7)], "account_id long, n_notes long")
    summary = {r.account_id: (r.n_notes, r.summary_chars, r.n_conflicts) for r in case.case_summary(cases, counts).collect()}
    assert summary == {1: (7, 8, 0), 2: (0, 1, 2), 3: (0, len(case.NO_SUMMARY), 0)}


def test_queries_give_the_whole_text_in_small_parts(spark, monkeypatch):
    from caseflow.operators import report
    from standins import catalogue

    whole, reassemble, section, context = {}, notes.reassemble, notes.notes_section, report.writer_context
    for small in (False, True):
        if small:
            monkeypatch.setattr(notes, "reassemble", lambda *a: reassemble(*a, 60))
            monkeypatch.setattr(notes, "notes_section", lambda rows: section(rows, 60))
            monkeypatch.setattr(report, "writer_context", lambda *a: context(*a, part_chars=50))
        for name, column, sep in (("spine_features", "note_text", " "), ("writer_context", "prompt", "")):
            rows = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").select("account_id", "part_no", column).collect()
            found = {}
            for r in sorted(rows, key=lambda r: (r[0], r[1])):
                found.setdefault(r[0], []).append(r[2])
            if small:
                assert max(map(len, found.values())) > 2
            texts = {a: sep.join(t for t in held if t is not None) for a, held in found.items()}
            assert whole.setdefault(name, texts) == texts


RAW = "account_id long, us long, category string, value double"


def test_cross_check(spark):
    us = 1704096000000000  # 2024-01-01 08:00
    raw = spark.createDataFrame(
        [(1, us, "lactate", 2.0), (1, us, "gcs", 14.9), (1, us, "creatinine", 0.0), (1, us + 10**12, "lactate", 9.0)], RAW
    )
    at = "01/01/2024 08:00"
    claims = records(
        spark,
        [(1, " Lactate ", "2.2", "", at), (1, "lactic acid", "2.21", "", at), (1, "gcs", "14", "", at),
         (1, "gcs", "13", "", at), (1, "cr", "0.1", "", at), (1, "cr", "0.11", "", at), (1, "lactate", "5", "", "unknown"),
         (1, "made up", "5", "", at), (1, "lactate", "n/a", "", at), (1, "platelets", "5", "", at), (2, "lactate", "5", "", at)],
        schemas.CLAIMS,
    )
    out = crosscheck.checked_claims(claims, raw, SEPSIS)
    assert sorted((r.parameter, r.claimed, r.is_mismatch) for r in out.collect()) == [
        ("cr", 0.1, False), ("cr", 0.11, True), ("gcs", 13.0, True), ("gcs", 14.0, False),
        ("lactate", 2.2, abs(2.2 - 2.0) / 2.0 > 0.10), ("lactic acid", 2.21, True),
    ]
    messages = [r.message for r in crosscheck.mismatches(out.filter("parameter = 'gcs'")).collect()]
    assert messages == [
        "NUMERIC MISMATCH: gcs - Notes claim 13.0 (at 01/01/2024 08:00), "
        "but raw data shows 14.9 (at 2024-01-01 08:00:00)"
    ]


def test_claims_are_read_once(spark):
    at = F.when(F.col("id") != 1, "01/01/2024 08:00").otherwise("unknown")
    claims = spark.range(3).select(
        F.lit(1).alias("account_id"), "id", F.lit("gcs").alias("parameter"), F.col("id").cast("string").alias("value"),
        at.alias("timestamp"),
    )
    raw = spark.createDataFrame([(1, 1704096000000000, "gcs", 2.0)], RAW)
    out = crosscheck.checked_claims(claims, raw, SEPSIS)
    assert sorted((r.id, r.claimed, r.is_mismatch) for r in out.collect()) == [(0, 0.0, True), (2, 2.0, False)]
    # neither the shape of a time nor that of a number is looked at again where claims are paired
    assert "RLIKE" not in _plan(out)


def test_conflict_lines(spark):
    frame = spark.createDataFrame(
        [(1, "CONFLICT 1: a: b\n CONFLICT 2:\nCONFLICT 3\nconflict 4: x\nRECOMMENDATION: do: it"), (2, "NO CONFLICTS DETECTED")],
        "account_id long, reply string",
    )
    a, b = crosscheck.conflict_lines(frame).orderBy("account_id").collect()
    assert (a.conflicts, a.recommendation, a.none_detected) == (["CONFLICT 1: a: b"], "do: it", False)
    assert (b.conflicts, b.recommendation, b.none_detected) == ([], "", True)
