"""Severity scores: SOFA over 24 hours, and the series of PaO2/FiO2 ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.times import DAY, HOUR, MONTH, SECOND, micros, stamp
from caseflow.functions.values import (
    any_of,
    band,
    berlin,
    categories,
    exact_round,
    first_category,
    number_text,
    oxygen_fraction,
    safe_double,
)
from caseflow.operators.asof import nearest_tagged, reading
from caseflow.operators.dense import DENSE_ROWS, dense_cuts, with_slice
from caseflow.operators.slices import SLICE, after, ordinal, slice_of
from caseflow.profiles import RESPIRATORY_FAILURE, SEPSIS, Profile
from caseflow.sources.sinks import staged

ORGANS = ("respiratory", "coagulation", "liver", "cardiovascular", "cns", "renal")
LEVELS = (1, 2, 3, 4)
FULL = "full_encounter"
SLIDING, ADMISSION, FIRST_DX = (
    "sliding_best_score",
    "poa_anchored_admission",
    "poa_anchored_first_dx",
)


def readings(
    labs: DataFrame,
    vitals: DataFrame,
    profile: Profile,
    whole_word: bool = False,
    exclusive: tuple[str, ...] = (),
) -> DataFrame:
    """Numbers ``(account_id, us, category, value)`` out of labs and vitals by name.

    A name may fall in several categories, except that of the ``exclusive`` ones it gets the
    first only.
    """

    def side(rows: DataFrame, name: str, value: str, kind: str) -> DataFrame:
        # The name is lower-cased once, not for each word it is looked at for. A value is read once: rows
        # without one get no categories, as a filter on the value would read it again ahead of the rest.
        low = rows.select(
            "account_id",
            micros(F.col("event_ts")).alias("us"),
            F.lower(name).alias("_name"),
            safe_double(F.col(value)).alias("value"),
        )
        found = categories(F.col("_name"), profile.matchers, kind, whole_word, exclusive, lowered=True)
        told = F.when(F.col("us").isNotNull() & F.col("value").isNotNull(), found)
        return low.select("account_id", "us", F.explode(told).alias("category"), "value").filter("category is not null")

    return side(labs, "lab_name", "lab_value", "lab").unionByName(
        side(vitals, "vital_name", "vital_value", "vital")
    )


def oxygen_ratios(
    values: DataFrame,
    tolerance_s: int | None,
    peep_tolerance_s: int | None = None,
    width_us: int = MONTH,
) -> DataFrame:
    """PaO2 readings with the nearest positive FiO2 (and PEEP); those without one are dropped.

    One pass over the readings: a row is marked as what it is and all are paired in one shuffle.
    """
    limits = {"fio2": None if tolerance_s is None else tolerance_s * SECOND}
    marks = {"fio2": (F.col("category") == "fio2") & (F.col("value") > 0)}
    if peep_tolerance_s is not None:
        limits["peep"] = peep_tolerance_s * SECOND
        marks["peep"] = F.col("category") == "peep"
    is_left = F.col("category") == "pao2"
    left = F.struct("us", F.struct(F.col("value").alias("pao2")).alias("row"))
    tagged = values.filter(is_left | any_of(list(marks.values()))).select(
        "account_id",
        F.when(is_left, left).alias("_left"),
        *[
            F.when(mark, reading(F.col("us"), ["value"], ["value"])).alias(f"_r_{name}")
            for name, mark in marks.items()
        ],
    )
    paired = nearest_tagged(tagged, ["account_id"], limits, width_us).filter("fio2 is not null")
    fraction = oxygen_fraction(F.col("fio2.value"))
    return paired.select(
        "account_id",
        "us",
        F.col("row.pao2").alias("pao2"),
        F.col("fio2.value").alias("fio2_raw"),
        fraction.alias("fio2_normalized"),
        *([F.col("peep.value").alias("peep")] if "peep" in limits else []),
        F.try_divide("row.pao2", fraction).alias("raw_ratio"),
    )


# --- P/F series -------------------------------------------------------------------------------


def pf_series(
    labs: DataFrame,
    vitals: DataFrame,
    profile: Profile = RESPIRATORY_FAILURE,
    width_us: int = MONTH,
    whole_word: bool = False,
) -> DataFrame:
    """Every PaO2/FiO2 ratio of an account in order of time, with its Berlin class."""
    # read once to look for dense slices, once to be paired
    values = staged(readings(labs, vitals, profile, whole_word, exclusive=("pao2", "fio2")))
    paired = oxygen_ratios(
        values, profile.pair_tolerance_s, profile.peep_tolerance_s, width_us
    ).withColumn("ratio", exact_round(F.col("raw_ratio"), 1))
    second = F.col("us") - F.pmod(F.col("us"), F.lit(SECOND))
    numbered = ordinal(
        paired,
        ["account_id"],
        second,
        [second, F.col("us"), F.col("pao2"), F.col("fio2_raw")],
        name="position",
        width=DAY,
    )
    return numbered.select(
        "account_id",
        F.col("position").cast("int").alias("position"),
        "us",
        stamp(F.col("us")).alias("timestamp"),
        "pao2",
        "fio2_raw",
        "fio2_normalized",
        "peep",
        "ratio",
        berlin(F.col("ratio")).alias("classification"),
    )


def pf_summary(series: DataFrame, render_below: float = 300) -> DataFrame:
    """One row per account: the worst ratio (earliest on ties), counts and the time span."""
    order = F.struct("ratio", "position")
    return series.groupBy("account_id").agg(
        F.count("*").cast("int").alias("measurements_calculated"),
        F.count("*").cast("int").alias("total_score"),
        F.count("*").cast("int").alias("organs_scored"),
        F.count(F.when(F.col("ratio") < render_below, 1)).cast("int").alias("n_qualifying"),
        F.min("ratio").alias("worst_ratio"),
        F.min_by("classification", order).alias("worst_classification"),
        F.min_by("timestamp", order).alias("worst_timestamp"),
        F.min("timestamp").alias("window_start"),
        F.max("timestamp").alias("window_end"),
        F.lit(FULL).alias("window_mode"),
    )


def pf_rows(cases: DataFrame, summary: DataFrame, as_of: Column) -> DataFrame:
    """The score table of the ratios: every case has a row, one without a pair an empty result.

    The measurements stay in their own table, one row each, so no account's list is gathered.
    """
    joined = cases.select("account_id").join(summary, "account_id", "left")
    counts = ("measurements_calculated", "total_score", "organs_scored", "n_qualifying")
    return joined.select(
        "account_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        "worst_ratio",
        "worst_classification",
        "worst_timestamp",
        "window_start",
        "window_end",
        F.lit(FULL).alias("window_mode"),
        as_of.alias("created_at"),
    )


# --- SOFA -------------------------------------------------------------------------------------


def drug_points(drug: Column, dose: Column) -> Column:
    """Cardiovascular points of a vasopressor; a dose that is not known earns the least."""
    strong = drug.isin("epinephrine", "norepinephrine")
    return (
        F.when((drug == "dopamine") & (dose > 15), 4)
        .when((drug == "dopamine") & (dose > 5), 3)
        .when(strong & (dose > 0.1), 4)
        .when(strong, 3)
        .otherwise(2)
    )


def organ_events(
    labs: DataFrame,
    vitals: DataFrame,
    meds: DataFrame,
    profile: Profile = SEPSIS,
    width_us: int = MONTH,
    whole_word: bool = False,
) -> DataFrame:
    """Everything that scores: ``(account_id, us, organ, score, value, display, drug, dose)``.

    The readings are staged, as they are scored and paired.
    """
    values = staged(readings(labs, vitals, profile, whole_word))
    bands = profile.bands
    v, category = F.col("value"), F.col("category")
    gcs = F.bround(v, 0).try_cast("int")

    # one pass over the readings scores all but the oxygen ratio
    organ = score = display = None
    for name, (of, number, label) in {
        "platelets": ("coagulation", v, ""),
        "bilirubin": ("liver", v, ""),
        "creatinine": ("renal", v, ""),
        "map": ("cardiovascular", v, "MAP = "),
        "gcs": ("cns", gcs, "GCS = "),
    }.items():
        is_it, start = category == name, organ is None
        points = band(number, bands[of])
        text = F.concat(F.lit(label), number.cast("string") if name == "gcs" else number_text(number))
        organ = F.when(is_it, of) if start else organ.when(is_it, of)
        score = F.when(is_it, points) if start else score.when(is_it, points)
        display = F.when(is_it, text) if start else display.when(is_it, text)
    no_drug = [F.lit(None).cast("string").alias("drug"), F.lit(None).cast("double").alias("dose")]
    plain = values.filter(category.isin("platelets", "bilirubin", "creatinine", "map", "gcs"))
    scored = plain.select(
        "account_id",
        "us",
        organ.alias("organ"),
        score.alias("score"),
        F.when(category == "gcs", gcs.cast("double")).otherwise(v).alias("value"),
        display.alias("display"),
        *no_drug,
    )
    ratio = F.col("raw_ratio")
    ratios = oxygen_ratios(values, profile.pair_tolerance_s, None, width_us).select(
        "account_id",
        "us",
        F.lit("respiratory").alias("organ"),
        band(ratio, bands["respiratory"]).alias("score"),
        ratio.alias("value"),
        F.concat(F.lit("PaO2/FiO2 = "), number_text(exact_round(ratio, 1))).alias("display"),
        *no_drug,
    )
    doses = meds.select(
        "account_id",
        micros(F.col("event_ts")).alias("us"),
        first_category(F.col("med_name"), profile.drugs).alias("drug"),
        safe_double(F.col("med_dose")).alias("dose"),
    ).filter("drug is not null and us is not null")
    drugs = doses.select(
        "account_id",
        "us",
        F.lit("vasopressor").alias("organ"),
        drug_points(F.col("drug"), F.col("dose")).alias("score"),
        F.col("dose").alias("value"),
        F.concat_ws(" ", "drug", number_text(F.col("dose"))).alias("display"),
        "drug",
        "dose",
    )
    return scored.unionByName(ratios).unionByName(drugs)


def best_windows(
    events: DataFrame, length_us: int = DAY, width_us: int = MONTH, dense_rows: int = DENSE_ROWS
) -> DataFrame:
    """Per account the window ``[a, a + length]``, ``a`` being a scored time, of highest total.

    The total of a window is a sum of maxima. "The organ reaches at least s within the window" is
    the same as "the next time at or after ``a`` with a score of at least s is no later than
    ``a + length``", and the next time is a running minimum over the descending order. It needs
    no frame of 24 hours, whose maxima Spark would take anew for every row, and it composes over
    slices: a slice is told the next time of each organ and level in the slices after it.
    """
    pairs = [(organ, level) for organ in ORGANS for level in LEVELS]
    name = {(o, s): f"_n_{o}_{s}" for o, s in pairs}
    columns = list(name.values())
    organ = F.when(F.col("organ") == "vasopressor", "cardiovascular").otherwise(F.col("organ"))
    # the events of an instant fall together in the tasks that read them, to the highest score of each organ
    peaks = events.groupBy("account_id", "us").agg(
        *[F.max(F.when(organ == o, F.col("score"))).alias(f"_p_{o}") for o in ORGANS]
    )
    cuts = dense_cuts(events, ["account_id"], F.col("us"), width_us, dense_rows)
    # The six peaks are shuffled and the times made of them there: all of a row is then asked for where slices
    # fall together as well as where they are ordered, so that both read one shuffle.
    sliced = (
        with_slice(peaks, ["account_id"], F.col("us"), width_us, cuts)
        .repartition("account_id", SLICE)
        .select(
            "account_id",
            SLICE,
            "us",
            *[F.when(F.col(f"_p_{o}") >= s, F.col("us")).alias(name[o, s]) for o, s in pairs],
        )
    )
    later = (
        sliced.groupBy("account_id", SLICE)
        .agg(*[F.min(c).alias(c) for c in columns])
        .select(
            "account_id",
            SLICE,
            F.lit(None).cast("long").alias("us"),
            *[F.min(c).over(after(["account_id"])).alias(c) for c in columns],
        )
        .repartition("account_id", SLICE)
    )
    # the carried row has no time of its own and sorts before all others, as the latest
    ahead = (
        Window.partitionBy("account_id", SLICE)
        .orderBy(F.col("us").desc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reach = sliced.unionByName(later).select(
        "account_id",
        "us",
        *[F.min(c).over(ahead).alias(c) for c in columns],
    )
    total = F.lit(0)
    for c in columns:
        total = total + F.when(F.col(c) <= F.col("us") + length_us, 1).otherwise(0)
    # highest total, then earliest time, as one long: times stay far below 2^56 microseconds
    rank = total.cast("long") * F.lit(1 << 56) - F.col("us")
    return (
        reach.filter("us is not null")
        .select("account_id", "us", total.alias("total"), rank.alias("rank"))
        .groupBy("account_id")
        .agg(F.max_by("us", "rank").alias("start_us"), F.max_by("total", "rank").alias("total"))
        .select(
            "account_id",
            "start_us",
            (F.col("start_us") + length_us).alias("end_us"),
            F.col("total").alias("total_score"),
        )
    )


def score_windows(
    events: DataFrame,
    anchors: DataFrame | None = None,
    length_us: int = DAY,
    width_us: int = MONTH,
) -> DataFrame:
    """The window each account is scored over, and how it was chosen.

    ``anchors`` holds ``(account_id, admit_ts, poa_code, first_dx_ts)``: code 1 fixes the window at
    admission, 2 at the first diagnosis; anything else slides. Accounts with nothing to score have
    no window.
    """
    columns = ("account_id", "start_us", "end_us", "window_mode")
    if anchors is None:
        return best_windows(events, length_us, width_us).withColumn("window_mode", F.lit(SLIDING)).select(*columns)
    admission = (F.col("poa_code") == 1) & F.col("admit_ts").isNotNull()
    first_dx = (F.col("poa_code") == 2) & F.col("first_dx_ts").isNotNull()
    start = F.when(admission, micros(F.col("admit_ts"))).otherwise(micros(F.col("first_dx_ts")))
    decided = anchors.filter(admission | first_dx).select(
        "account_id",
        start.alias("start_us"),
        (start + length_us).alias("end_us"),
        F.when(admission, ADMISSION).otherwise(FIRST_DX).alias("window_mode"),
    )
    # only accounts that no anchor decides are searched
    free = events.join(decided.select("account_id"), "account_id", "left_anti")
    sliding = best_windows(free, length_us, width_us).withColumn("window_mode", F.lit(SLIDING))
    fixed = decided.join(events.select("account_id").distinct(), "account_id", "left_semi")
    return fixed.unionByName(sliding.select(*columns))


def in_windows(events: DataFrame, windows: DataFrame, width_us: int = HOUR) -> DataFrame:
    """Each window with the events inside it, both ends included; a window without any stays.

    Joined by account and slice: each window is repeated for the few slices it touches, so the
    events of one account spread over as many tasks as it has slices.
    """
    slices = F.sequence(
        slice_of(F.col("start_us"), width_us), slice_of(F.col("end_us"), width_us), F.lit(width_us)
    )
    touched = windows.withColumn(SLICE, F.explode(slices))
    sliced = events.withColumn(SLICE, slice_of(F.col("us"), width_us))
    on = (
        (touched["account_id"] == sliced["account_id"])
        & (touched[SLICE] == sliced[SLICE])
        & F.col("us").between(F.col("start_us"), F.col("end_us"))
    )
    return touched.join(sliced, on, "left").select(
        touched["account_id"],
        "start_us",
        "end_us",
        "window_mode",
        "us", "organ", "score", "value", "display", "drug", "dose",
    )


WINDOW = ("account_id", "start_us", "end_us", "window_mode")


def window_scores(inside: DataFrame) -> DataFrame:
    """One row per window: its organs as an array, their total, the drugs given.

    Organs other than the cardiovascular are present even at 0. Blood pressure must score above 0
    to count, and a drug must beat it; among drugs of equal points the first one given counts, at
    its highest dose. Events fall together per organ and drug before the shuffle; at most twelve
    rows per account are then gathered.
    """
    # highest score, then earliest time; a dose beats no dose, of equal doses the first
    is_drug = F.col("organ") == "vasopressor"
    order = F.struct(
        F.when(is_drug, F.col("dose").isNotNull()).alias("known"),
        F.when(is_drug, F.col("dose")).otherwise(F.col("score")).alias("most"),
        (-F.col("us")).alias("early"),
        F.when(~is_drug, F.col("value")).alias("value"),
    )
    groups = inside.groupBy(*WINDOW, "organ", "drug").agg(
        F.max("score").alias("score"),
        F.min("us").alias("first_us"),
        F.max_by(F.struct(F.col("display").alias("value"), "us"), order).alias("shown"),
    )
    entry = F.struct(
        "organ", "score", F.col("shown.value").alias("value"), F.col("shown.us").alias("us"),
        (-F.col("first_us")).alias("beats"), "drug",
    )
    gathered = groups.groupBy(*WINDOW).agg(
        F.array_sort(F.collect_list(F.when(F.col("organ").isNotNull(), entry))).alias("_all")
    )
    cardiac = F.filter(
        "_all",
        lambda e: (e["organ"] == "vasopressor")
        | ((e["organ"] == "cardiovascular") & (e["score"] > 0)),
    )
    # pressure earns 1 and any drug at least 2, so only drugs can tie
    ranked = F.transform(
        cardiac,
        lambda e: F.struct(e["score"].alias("score"), e["beats"].alias("beats"),
                           e["value"].alias("value"), e["us"].alias("us")),
    )
    top = F.array_max(ranked)
    heart = F.when(
        F.size(cardiac) > 0,
        F.array(
            F.struct(
                F.lit("cardiovascular").alias("organ"),
                top["score"].alias("score"),
                top["value"].alias("value"),
                top["us"].alias("us"),
            )
        ),
    )
    plain = F.transform(
        F.filter("_all", lambda e: ~e["organ"].isin("cardiovascular", "vasopressor")),
        lambda e: F.struct(e["organ"].alias("organ"), e["score"].alias("score"),
                           e["value"].alias("value"), e["us"].alias("us")),
    )
    organs = F.concat(plain, F.coalesce(heart, F.slice(plain, 1, 0)))
    drugs = F.transform(F.filter("_all", lambda e: e["drug"].isNotNull()), lambda e: e["drug"])
    rows = gathered.select(
        *WINDOW, organs.alias("organs"), F.array_join(F.array_sort(drugs), ", ").alias("drugs")
    )
    total = F.aggregate("organs", F.lit(0), lambda t, o: t + o["score"])
    return rows.select(
        "account_id",
        total.alias("total_score"),
        F.size("organs").alias("organs_scored"),
        "organs",
        F.nullif("drugs", F.lit("")).alias("vasopressors"),
        stamp(F.col("start_us")).alias("window_start"),
        stamp(F.col("end_us")).alias("window_end"),
        "window_mode",
    )


def sofa(
    events: DataFrame,
    anchors: DataFrame | None = None,
    length_us: int = DAY,
    width_us: int | None = None,
) -> DataFrame:
    """One row per account with something to score: totals, organs, drugs and the window.

    ``events`` (the table of ``organ_events``) is read twice; stage it if it is dear to compute.
    """
    windows = score_windows(events, anchors, length_us, width_us or MONTH)
    return window_scores(in_windows(events, windows, width_us or HOUR))


def organ_rows(scores: DataFrame) -> DataFrame:
    """One row per account and organ."""
    return scores.select("account_id", F.explode("organs").alias("o")).select(
        "account_id", "o.organ", "o.score", "o.value", stamp(F.col("o.us")).alias("timestamp")
    )


def encounter_scores(events: DataFrame) -> DataFrame:
    """Scores over the whole encounter, without a window."""
    everything = events.select(
        "account_id",
        F.lit(None).cast("long").alias("start_us"),
        F.lit(None).cast("long").alias("end_us"),
        F.lit("encounter").alias("window_mode"),
        "us", "organ", "score", "value", "display", "drug", "dose",
    )
    return window_scores(everything)


def organ_map() -> Column:
    """Organs by name, as they are stored with the scores."""
    return F.map_from_entries(
        F.transform(
            "organs",
            lambda o: F.struct(
                o["organ"].alias("key"),
                F.struct(
                    o["score"].alias("score"),
                    o["value"].alias("value"),
                    stamp(o["us"]).alias("timestamp"),
                ).alias("value"),
            ),
        )
    )


def score_rows(cases: DataFrame, scores: DataFrame, as_of: Column) -> DataFrame:
    """The score table: every case has a row, an unscored one an empty result."""
    return cases.select("account_id").join(scores, "account_id", "left").select(
        "account_id",
        F.coalesce("total_score", F.lit(0)).alias("total_score"),
        F.coalesce("organs_scored", F.lit(0)).alias("organs_scored"),
        F.coalesce(F.to_json(organ_map()), F.lit("{}")).alias("organ_scores"),
        "vasopressors",
        "window_start",
        "window_end",
        F.coalesce("window_mode", F.lit(SLIDING)).alias("window_mode"),
        as_of.alias("created_at"),
    )
