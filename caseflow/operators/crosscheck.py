"""Numbers claimed in notes against the nearest raw reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import stripped
from caseflow.functions.times import MONTH, parsed, stamp
from caseflow.functions.values import number_text, relative_gap, safe_double
from caseflow.operators.asof import Series, nearest
from caseflow.profiles import Profile
from caseflow.sources.sinks import staged

# Scales compared as whole numbers; elsewhere 10 percent is the tolerated gap.
INTEGER_SCALES = ("gcs",)
TOLERATED_GAP = 0.10


def checked_claims(
    claims: DataFrame, raw: DataFrame, profile: Profile, width_us: int = MONTH
) -> DataFrame:
    """Each checkable claim with its nearest reading and the verdict ``is_mismatch``.

    ``claims``: ``(account_id, parameter, value, timestamp)`` as text. ``raw``: the table of
    ``scores.readings``. A claim without a number, a known parameter or a readable time is not
    checkable, nor is one whose account has no reading of that category.

    Claims and readings are staged, as they are read to look for dense slices and to be paired. Claims are
    staged before those that are not checkable are dropped: a filter on what was read out of text would go
    ahead of the reading and repeat it.
    """
    names = profile.parameter_categories
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parameter = stripped(F.lower("parameter"))
    stated = claims.select(
        "account_id",
        *[c for c in claims.columns if c not in ("account_id", "parameter", "value", "timestamp")],
        parameter.alias("parameter"),
        safe_double(F.col("value")).alias("claimed"),
        F.col("timestamp").alias("claim_time"),
        parsed(F.col("timestamp")).alias("claim_ts"),
        F.try_element_at(table, parameter).alias("category"),
    )
    known = staged(stated).filter("claimed is not null and category is not null and claim_ts is not null")
    readings = staged(raw.select("account_id", "category", F.timestamp_micros("us").alias("ts"), "value"))
    near = nearest(
        known,
        ["account_id", "category"],
        "claim_ts",
        {"raw": Series(readings, "ts", ["value"], ["value"])},
        width_us,
    ).filter("raw is not null")
    # without their fractions, as doubles: a claim may be larger than any integer
    claimed, raw_value = F.col("claimed"), F.col("raw.value")
    whole = (claimed - claimed % 1) != (raw_value - raw_value % 1)
    apart = relative_gap(F.col("claimed"), F.col("raw.value")) > TOLERATED_GAP
    return near.select(
        *[c for c in near.columns if c not in ("raw", "claim_ts")],
        F.col("raw.value").alias("raw_value"),
        stamp(F.col("raw.us")).alias("raw_time"),
        F.when(F.col("category").isin(*INTEGER_SCALES), whole)
        .otherwise(apart)
        .alias("is_mismatch"),
    )


def mismatches(checked: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("NUMERIC MISMATCH: "),
        "parameter",
        F.lit(" - Notes claim "),
        number_text(F.col("claimed")),
        F.lit(" (at "),
        "claim_time",
        F.lit("), but raw data shows "),
        number_text(F.col("raw_value")),
        F.lit(" (at "),
        "raw_time",
        F.lit(")"),
    )
    return checked.filter("is_mismatch").withColumn("message", text)


def conflict_lines(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """``CONFLICT n: text`` lines and the ``RECOMMENDATION:`` out of each reply.

    A conflict line counts if text follows its colon; the last recommendation wins.
    """
    lines = F.transform(F.split(F.col(reply), "\n"), lambda x: stripped(x))
    conflicts = F.filter(
        lines,
        lambda x: x.startswith("CONFLICT")
        & (stripped(F.regexp_replace(x, "^[^:]*:?", "")) != ""),
    )
    advice = F.filter(lines, lambda x: x.startswith("RECOMMENDATION:"))
    last = F.coalesce(F.try_element_at(advice, F.lit(-1)), F.lit(""))
    return replies.select(
        *[c for c in replies.columns if c != reply],
        conflicts.alias("conflicts"),
        stripped(F.replace(last, F.lit("RECOMMENDATION:"), F.lit(""))).alias("recommendation"),
        F.contains(F.col(reply), F.lit("NO CONFLICTS DETECTED")).alias("none_detected"),
    )


def merged_conflicts(conflicts: DataFrame, found: DataFrame) -> DataFrame:
    """One row per conflict: those of the reply, then the numeric mismatches.

    Kept long, so that an account with very many mismatches fills rows and not one value.
    """
    stated = conflicts.select(
        "account_id", F.posexplode("conflicts").alias("position", "conflict")
    ).select("account_id", F.lit("reply").alias("origin"), "position", "conflict")
    numeric = found.select(
        "account_id",
        F.lit("numeric").alias("origin"),
        F.lit(None).cast("int").alias("position"),
        F.col("message").alias("conflict"),
    )
    return stated.unionByName(numeric)
