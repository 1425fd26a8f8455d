import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from caseflow import profiles, schemas
from caseflow.operators import quality, windows
from caseflow.plans import spine, workqueue
from caseflow.sources import documents, sinks, tables
from caseflow.streaming import incremental


def test_profiles_are_whole():
    for profile in profiles.PROFILES.values():
        assert profiles.missing_attributes(profile) == []
        assert profiles.unmatched_categories(profile) == set()
    assert profiles.get_profile("sepsis").denial_field == "IS_SEPSIS"
    assert len(profiles.REQUIRED) == 14
    assert set(profiles.REQUIRED) <= set(profiles.attribute_names())


def test_all_missing_attributes_are_named_at_once():
    with pytest.raises(ValueError) as error:
        profiles.validate(profiles.Profile(name="x", display_name="X"))
    assert "scores_table" in str(error.value) and "criteria_label" in str(error.value)
    with pytest.raises(KeyError):
        profiles.get_profile("none")


def test_tables_are_created_once(spark):
    schema = "a long, b string"
    assert sinks.create_if_missing(spark, "t_once", schema)
    assert not sinks.create_if_missing(spark, "t_once", schema)
    assert not sinks.create_from(spark.range(1), "t_once")
    assert sinks.create_from(spark.range(3), "t_from") and spark.table("t_from").count() == 3


def test_append_overwrite_and_unseen(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "a long, b string")
    sinks.create_if_missing(spark, "t_rows", "a long, b string, c int")
    sinks.insert_unseen(rows, "t_rows", ("a", "b"))
    sinks.insert_unseen(rows.union(spark.createDataFrame([(1, "z")], rows.schema)), "t_rows", ("a", "b"))
    assert spark.table("t_rows").count() == 4
    assert spark.table("t_rows").filter("c is null").count() == 4
    sinks.overwrite(rows, "t_rows")
    assert spark.table("t_rows").count() == 3


def test_slices_are_replaced(spark, tmp_path):
    path = str(tmp_path / "kb")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    sinks.replace_slice(first, path, "k")
    sinks.replace_slice(spark.createDataFrame([("a", 9)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_widening_stamp_stage_and_texts(spark, tmp_path):
    path = str(tmp_path / "wide")
    sinks.append_widening(spark.range(1), path)
    sinks.append_widening(spark.range(1).withColumn("x", F.lit("new")), path)
    assert sinks.read_widened(spark, path).columns == ["id", "x"]
    assert sinks.stamped(spark.range(1)).columns == ["id", "insert_tsp"]
    staged = sinks.staged(spark.range(5))
    assert staged.count() == 5 and "Range" not in staged._jdf.queryExecution().toString()
    letters = spark.createDataFrame([(1, "a\nb"), (2, "c")], "k long, t string")
    sinks.write_texts(letters, str(tmp_path / "letters"), "k", "t")
    back = documents.text_documents(spark, str(tmp_path / "letters" / "k=1"))
    assert back.first().text == "a\nb\n"


def test_file_listings(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_text("x")
    files = documents.listing(spark, str(tmp_path))
    assert {r.extension: r.n_files for r in quality.files_by_extension(files).collect()} == {"pdf": 2, "txt": 1}
    loaded = spark.createDataFrame([("a.pdf",)], "file_name string")
    assert sorted(r.file_name for r in documents.new_files(files, loaded).collect()) == ["b.PDF", "c.txt"]
    assert quality.check_files(files, "letters", ".pdf", 3).first().passed is False
    (tmp_path / "map.csv").write_text("map_to,id\nPayor,007\n")
    assert tables.lookup(spark, str(tmp_path / "map.csv")).first().id == "007"


def test_sources(spark, monkeypatch):
    monkeypatch.setenv("CASEFLOW_READ", "spark_catalog.default")
    s = tables.Sources.from_environment(spark)
    assert s.source_name("t") == "spark_catalog.default.t" and s.target_name("t") == "t"
    tables.shared_view(spark.range(2), "v_shared")
    assert spark.table("v_shared").count() == 2


def test_checks(spark):
    rows = spark.range(2)
    assert quality.check_table(rows, "t", ("id", "z", "y")).first().missing_columns == "y, z"
    assert quality.check_table(rows, "t", ("id",), 3).first().passed is False
    assert quality.check_named_table(spark, "no_such_table", ("a",)).first().passed is False
    both = quality.all_checks(quality.check_table(rows, "t", ("id",)), quality.check_table(rows, "t", ("z",)))
    assert tuple(quality.check_summary(both).first()) == (1, 2, False)


def test_schemas_make_rows(spark):
    row = schemas.records(spark, [(1, "text", None)], schemas.CASE_SUMMARY).first()
    assert row.account_id == 1 and row.created_at is None


QUEUE = "account_id long, entry_date date, financial_class int"


def test_population(spark):
    queue = spark.createDataFrame(
        [(1, date(2024, 1, 1), 115), (2, date(2024, 3, 1), 100), (3, date(2024, 1, 1), 999), (4, date(2024, 1, 1), 1), (5, date(2024, 3, 9), 1)],
        QUEUE,
    )
    scored = spark.createDataFrame([(date(2024, 2, 1),)], "entry_date date")
    processed = spark.createDataFrame([(1,), (2,), (None,)], "account_id long")
    out = workqueue.population(queue, scored, processed, F.to_date(F.lit("2024-03-10"))).collect()
    assert sorted((r.account_id, r.letter_type) for r in out) == [(2, "Commercial"), (4, "Commercial")]
    # nothing scored yet: the default mark decides, and unprocessed accounts are due
    none = workqueue.population(queue, scored.limit(0), processed, F.to_date(F.lit("2024-03-10"))).collect()
    assert [r.account_id for r in none] == [4]


def test_addresses_in_rule_order(spark):
    rules = spark.createDataFrame(
        [("Plans", 1, 10, "plan"), ("Payor", 1, 99, "payor"), ("Payor", 1, 99, "payor2"), ("Payor and Location?", 3, 0, "loc"), ("Payor or plan", 4, 40, "either")],
        "map_to string, mapped_payor_id int, mapped_plan_id int, payor_address string",
    )
    accounts = spark.createDataFrame(
        [(1, "n", 1, 10), (2, "n", 7, 10), (3, "in", 3, 1), (4, "n", 3, 1), (5, "n", 8, 40), (6, "n", None, None), (6, "n", 9, 9)],
        "account_id long, npi string, payor_id int, plan_id int",
    )
    out = {r.account_id: r.mapped_address for r in workqueue.mapped_addresses(accounts, rules, ("in",)).collect()}
    assert out == {1: "payor", 2: "plan", 3: "loc", 4: None, 5: "either", 6: None}


def test_incremental(spark):
    ts = lambda d: datetime(2024, 1, d)
    source = spark.createDataFrame([(1, ts(1)), (2, ts(1)), (1, ts(9)), (None, ts(1))], "account_id long, insert_tsp timestamp")
    scored = spark.createDataFrame([(1, ts(5)), (None, ts(2))], "account_id long, insert_tsp timestamp")
    default = F.to_timestamp(F.lit("2025-07-01"))
    out = incremental.to_score(source, scored, default).collect()
    assert sorted((r.account_id or 0, r.insert_tsp.day) for r in out) == [(0, 1), (1, 9), (2, 1)]
    assert incremental.to_score(source, scored.limit(0), default).count() == 4
    letters = spark.createDataFrame([(1, "x" * 101), (2, "x" * 100), (3, None), (4, "y" * 200)], "letter_id long, letter_text string")
    done = spark.createDataFrame([(4,)], "letter_id long")
    out = {r.letter_id: r.skip_reason for r in incremental.unprocessed_letters(letters, done).collect()}
    assert out == {1: None, 2: "Insufficient text (100 chars)", 3: "Insufficient text (0 chars)"}


def test_files_are_taken_in_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "letter_id long, letter_text string"
    sinks.create_if_missing(spark, "t_in", schema)
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema)
    rows.write.parquet(folder)
    for _ in range(2):
        incremental.ingest_available(spark, folder, schema, "t_in", ("letter_id",), "t_in").awaitTermination()
    rows.union(spark.createDataFrame([(3, "c")], schema)).write.mode("append").parquet(folder)
    incremental.ingest_available(spark, folder, schema, "t_in", ("letter_id",), "t_in").awaitTermination()
    assert sorted(r.letter_id for r in spark.table("t_in").collect()) == [1, 2, 3]


def test_tops_are_cut_before_the_shuffle(spark):
    frame = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    top = windows.top_per(frame, ["k"], [F.col("id").desc()], 2)
    assert sorted(r.id for r in top.collect()) == [96, 97, 98, 99]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_spine_keeps_every_account(spark):
    accounts = spark.createDataFrame([(1,), (2,), (2,)], "account_id long")
    enc = spark.createDataFrame([(1, 5, datetime(2024, 1, 1)), (1, 6, datetime(2024, 2, 1)), (2, 7, None)], "account_id long, encounter_id long, admit_ts timestamp")
    out = {r.account_id: r.encounter_id for r in spine.spine_features(accounts, spine.latest_encounters(enc)).collect()}
    assert out == {1: 6, 2: None}


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_staged_files_can_be_removed(spark, tmp_path):
    from caseflow.sources import sinks

    rows = sinks.staged(spark.range(5))
    assert rows.count() == 5
    folder = sinks._staging_folder(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    sinks.remove_staged(spark)
    assert not os.path.exists(folder)


def test_keys_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = spark.createDataFrame([(i, f"old{i}") for i in range(40)], "account_id long, v string")
    sinks.write_keyed(rows, path, "account_id", 8)
    before = {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path) if f.startswith("_bucket")}
    # key 3 gets other rows, key 5 has none any more, key 100 is new
    fresh = spark.createDataFrame([(3, "new"), (3, "new too"), (100, "first")], rows.schema)
    keys = spark.createDataFrame([(3,), (5,), (100,), (3,)], "account_id long")
    for _ in range(2):  # again: nothing changes
        sinks.replace_keys(fresh, keys, path, "account_id", 8)
        found = sorted(tuple(r) for r in spark.read.schema(rows.schema).parquet(path).select("account_id", "v").collect())
        assert found == sorted([(i, f"old{i}") for i in range(40) if i not in (3, 5)] + [(3, "new"), (3, "new too"), (100, "first")])
    after = {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path) if f.startswith("_bucket")}
    assert 0 < sum(before[f] != after.get(f) for f in before) <= 3


def test_a_bucket_that_loses_all_its_rows(spark, tmp_path):
    path = str(tmp_path / "emptied")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "account_id long, v string")
    sinks.write_keyed(rows, path, "account_id", 1000)
    sinks.replace_keys(rows.limit(0), rows.filter("account_id = 1"), path, "account_id", 1000)
    assert [r.v for r in spark.read.parquet(path).collect()] == ["b"]


def test_refresh_recomputes_what_changed_and_equals_a_full_run(spark, tmp_path):
    path, seen = str(tmp_path / "refreshed"), []
    events = spark.range(1000).selectExpr("id % 50 account_id", "timestamp_seconds(id) event_ts", "id v")
    other = spark.range(10).selectExpr("id + 45 account_id", "timestamp_seconds(id) event_ts", "1 w")

    def compute(t):
        seen.append(t["events"].count())
        sums = t["events"].groupBy("account_id").agg(F.sum("v").alias("total"))
        return sums.join(t["other"].groupBy("account_id").agg(F.sum("w").alias("w")), "account_id", "full")

    mark = F.timestamp_seconds(F.lit(989))
    late = {"events": events, "other": other}
    old = {n: x.filter(F.col("event_ts") <= mark) for n, x in late.items()}
    sinks.write_keyed(compute(old), path, "account_id")
    keys = incremental.touched(late, mark)
    assert keys.count() == 10
    incremental.refresh(path, keys, late, compute)
    whole = compute(late)
    found = spark.read.schema(whole.schema).parquet(path).select(*whole.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    assert seen == [990, 200, 1000]


def test_checks_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "a long, b string")
    watched, seen = quality.watched(rows.repartition(3), ("b",))
    watched.write.parquet(str(tmp_path / "watched"))
    assert watched.columns == ["a", "b"]
    for expected, least in (((), 1), (("a", "z"), 1), ((), 4)):
        assert quality.check_watched(watched, seen, "x", expected, least).first() == quality.check_table(rows, "x", expected, least).first()
    assert quality.watched_counts(watched, seen).first().asDict() == {"n_rows": 3, "n_b": 2}


def test_populations_in_order(spark):
    a = spark.createDataFrame([(2, "2024-01-02"), (1, "2024-01-03"), (5, None)], "account_id long, entry_date string")
    b = spark.createDataFrame([(3, "2024-01-02", "x"), (1, "2024-01-01", "y")], "account_id long, entry_date string, why string")
    assert [tuple(r) for r in workqueue.in_order(a, b).collect()] == [
        (5, None, None), (1, "2024-01-01", "y"), (2, "2024-01-02", None), (3, "2024-01-02", "x"), (1, "2024-01-03", None)
    ]


def test_bucketed_case_tables_are_read_back_without_a_shuffle(spark):
    from caseflow.plans import case

    ids = spark.range(200).withColumnRenamed("id", "account_id")
    tables_ = {
        "denial": ids.selectExpr("account_id", "concat('d', account_id) denial_text", "'p' payor", "'1' original_drg", "'2' proposed_drg", "true is_condition_match"),
        "clinical": ids.filter("account_id % 2 = 0").selectExpr("account_id", "'n' patient_name", "'b' patient_dob", "'f' facility_name", "'s' date_of_service"),
        "summary": ids.filter("account_id % 3 = 0").selectExpr("account_id", "'sum' structured_summary"),
        "scores": ids.selectExpr("account_id", "1 total_score", "2 organs_scored"),
        "conflicts": ids.limit(5).selectExpr("account_id", "array('x') conflicts", "'r' recommendation"),
    }
    for name, rows in tables_.items():
        sinks.write_bucketed(rows, f"case_{name}", buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = case.read_back(*(spark.table(f"case_{name}") for name in tables_))
        plan = stored._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(str, stored.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 4
    assert found == sorted(map(str, case.read_back(*tables_.values()).collect()))
