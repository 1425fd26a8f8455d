import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators.asof import Series, nearest
from caseflow.operators.dense import dense_cuts, with_slice
from caseflow.operators.slices import SLICE, ordinal
from caseflow.functions.times import micros
from tests.models import nearest as model

SECOND = 1_000_000


def frames(spark, lefts, rights):
    left = spark.createDataFrame([(k, t, i) for i, (k, t) in lefts.items()], "k int, t long, id int")
    right = spark.createDataFrame(rights, "k int, t long, v double")
    to_ts = F.timestamp_micros("t")
    return left.withColumn("ts", to_ts).drop("t"), right.withColumn("ts", to_ts).drop("t")


@pytest.mark.parametrize("width", [3, 40, 10**6])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_equals_the_model_for_any_slice_width(spark, width, tolerance):
    rnd = random.Random(width)
    lefts = {i: (rnd.randint(0, 2), rnd.randint(-50, 150) * SECOND) for i in range(200)}
    rights = [
        (rnd.randint(0, 2), rnd.randint(-50, 150) * SECOND, float(rnd.randint(0, 3)))
        for _ in range(80)
    ]
    limit = None if tolerance is None else tolerance * SECOND
    left, right = frames(spark, lefts, rights)
    series = {"r": Series(right, "ts", ["v"], ["v"], limit)}
    rows = nearest(left, ["k"], "ts", series, width * SECOND).collect()
    assert len(rows) == len(lefts)
    assert {r.id: r.r and (r.r.us, r.r.v) for r in rows} == model(lefts, rights, limit)


def test_ties_and_limits(spark):
    lefts = {1: (1, 1000 * SECOND), 2: (1, 9000 * SECOND), 3: (1, 20000 * SECOND), 4: (2, 0)}
    rights = [
        (1, 900 * SECOND, 5.0), (1, 1100 * SECOND, 1.0),  # equal distance: the earlier
        (1, 9000 * SECOND + 1800 * SECOND, 7.0),  # exactly at the limit
        (1, 20000 * SECOND + 1801 * SECOND, 8.0),  # just beyond
    ]
    left, right = frames(spark, lefts, rights)
    rows = nearest(left, ["k"], "ts", {"r": Series(right, "ts", ["v"], ["v"], 1800 * SECOND)}, 3600 * SECOND)
    assert {r.id: r.r and r.r.v for r in rows.collect()} == {1: 5.0, 2: 7.0, 3: None, 4: None}


def test_rows_without_time_or_key_stay_and_meet_nothing(spark):
    left = spark.createDataFrame([(1, None, 1), (None, 5, 2), (1, 5, 3)], "k int, t long, id int")
    right = spark.createDataFrame([(1, 5, 2.0), (None, 5, 3.0), (1, None, 4.0)], "k int, t long, v double")
    ts = F.timestamp_micros("t")
    rows = nearest(
        left.withColumn("ts", ts), ["k"], "ts",
        {"r": Series(right.withColumn("ts", ts), "ts", ["v"])},
    ).collect()
    assert {r.id: r.r and r.r.v for r in rows} == {1: None, 2: None, 3: 2.0}


def test_two_series_in_one_pass(spark):
    lefts = {1: (1, 100 * SECOND)}
    left, right = frames(spark, lefts, [(1, 90 * SECOND, 1.0), (1, 200 * SECOND, 2.0)])
    series = {
        "a": Series(right.filter("v = 1"), "ts", ["v"]),
        "b": Series(right.filter("v = 2"), "ts", ["v"], (), 50 * SECOND),
    }
    row = nearest(left, ["k"], "ts", series).first()
    assert row.a.v == 1.0 and row.a.gap_us == 10 * SECOND and row.b is None


def test_the_rows_are_shuffled_once(spark):
    left, right = frames(spark, {1: (1, 5), 2: (1, 9)}, [(1, 7, 1.0)])
    out = nearest(left, ["k"], "ts", {"r": Series(right, "ts", ["v"])})
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the window over the union of rows and carried rows needs no exchange of its own
    top = plan[: plan.index("Union")]
    assert "Exchange" not in top


def test_partitions_do_not_change_the_result(spark):
    rnd = random.Random(5)
    lefts = {i: (0 if rnd.random() < 0.7 else i % 5, rnd.randint(0, 10**4) * SECOND) for i in range(500)}
    rights = [(rnd.randint(0, 4), rnd.randint(0, 10**4) * SECOND, float(i)) for i in range(300)]
    left, right = frames(spark, lefts, rights)
    expected = model(lefts, rights)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(
        "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    )
    try:
        for partitions, size in (("1", "64m"), ("17", "1k"), ("7", "2k")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
            out = nearest(left.repartition(5), ["k"], "ts", {"r": Series(right, "ts", ["v"], ["v"])}, 600 * SECOND)
            assert {r.id: r.r and (r.r.us, r.r.v) for r in out.collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old[1])
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def test_ordinal_numbers_whole_keys(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 1), None if rnd.random() < 0.1 else rnd.randint(0, 50), i) for i in range(150)]
    frame = spark.createDataFrame(rows, "k int, t long, id int")
    out = ordinal(frame, ["k"], F.col("t"), [F.col("t"), F.col("id")], width=7).collect()
    for key in (0, 1):
        mine = sorted((r for r in out if r.k == key), key=lambda r: r.ordinal)
        assert [r.ordinal for r in mine] == list(range(len(mine)))
        order = [(r.t is not None, r.t or 0, r.id) for r in mine]
        assert order == sorted(order)


def test_micros_is_exact(spark):
    row = spark.sql("select timestamp_ntz '2024-01-01 00:00:07.179575' as t").select(micros(F.col("t")).alias("u"))
    assert row.first().u == 1704067207179575


@pytest.mark.parametrize("dense_rows", [3, 20])
def test_dense_slices_change_nothing(spark, dense_rows):
    """Most rows of a key within one slice, many at one instant."""
    rnd = random.Random(dense_rows)
    when = lambda: rnd.choice([rnd.randint(0, 400), 7, rnd.randint(3600, 9000)]) * SECOND
    lefts = {i: (rnd.choice([1, 1, 1, 2]), when()) for i in range(200)}
    rights = [(rnd.choice([1, 1, 1, 2]), when(), float(rnd.randint(0, 3))) for _ in range(120)]
    left, right = frames(spark, lefts, rights)
    rows = nearest(left, ["k"], "ts", {"r": Series(right, "ts", ["v"], ["v"])}, 3600 * SECOND, dense_rows).collect()
    assert {r.id: r.r and (r.r.us, r.r.v) for r in rows} == model(lefts, rights, None)


def test_dense_slices_are_dealt_evenly(spark):
    """One key holds a third of all rows within one hour: its pieces are about as large as each other."""
    hour = 3600 * SECOND
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        # denser and denser towards the end of the hour
        (hour * F.sqrt(F.rand(5))).cast("long").alias("us"),
    )
    assert dense_cuts(rows, ["k"], F.col("us"), hour, most=20_000) is None
    cuts = dense_cuts(rows, ["k"], F.col("us"), hour, most=1000, pieces=16)
    assert [r.k for r in cuts.collect()] == [0]
    counts = [r[0] for r in with_slice(rows, ["k"], F.col("us"), hour, cuts).filter("k = 0").groupBy(SLICE).count().select("count").collect()]
    assert len(counts) == 16 and max(counts) < 2 * sorted(counts)[8] and sum(counts) == 10_000
