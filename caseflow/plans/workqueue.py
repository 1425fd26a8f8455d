"""The batch of new denials: who is due, where letters go, who changed from observation to stay."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.operators.windows import top_per

# Financial classes by letter type, and the days a new entry rests.
MEDICARE_CLASSES = (115, 116)
COMMERCIAL_CLASSES = (100, 1, 109, 110, 111, 112, 106, 113, 114)
EMBARGO_DAYS = 5
DEFAULT_MARK = "2025-07-01"


def letter_type(financial_class: Column, classes: dict[str, Sequence] | None = None) -> Column:
    classes = classes or {"Medicare": MEDICARE_CLASSES, "Commercial": COMMERCIAL_CLASSES}
    result = F.when(F.lit(False), "")
    for name, members in classes.items():
        result = result.when(financial_class.isin(*members), name)
    return result


def high_water_mark(scored: DataFrame, column: str, default: Column) -> Column:
    """Latest value already scored, as a scalar subquery; the default for an empty table."""
    return scored.agg(F.coalesce(F.max(column), default).alias("mark")).scalar()


def in_order(*populations: DataFrame) -> DataFrame:
    """Populations one after the other as one, by entry date, then account; columns one lacks are null there."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), populations)
    return rows.orderBy("entry_date", "account_id", *[c for c in rows.columns if c not in ("entry_date", "account_id")])


def population(
    queue: DataFrame,
    scored: DataFrame,
    processed: DataFrame,
    as_of: Column,
    classes: dict[str, Sequence] | None = None,
    default_mark: Column | None = None,
) -> DataFrame:
    """Queue entries due for a letter.

    ``queue``: ``(account_id, entry_date, financial_class, …)``. An entry is due if it is newer than
    the latest scored entry or its account was never processed, once it has rested. One scan tells
    the letter type by the class. "Not in the processed ones" is an outer join to the distinct
    processed accounts, so a null among them does not hide every account.
    """
    default = F.to_date(F.lit(DEFAULT_MARK)) if default_mark is None else default_mark
    mark = high_water_mark(scored, "entry_date", default)
    known = (
        processed.select("account_id").filter("account_id is not null").distinct()
    ).withColumn("_known", F.lit(True))
    due = (F.col("entry_date") > mark) | F.col("_known").isNull()
    return (
        queue.withColumn("letter_type", letter_type(F.col("financial_class"), classes))
        .filter(F.col("letter_type").isNotNull())
        .filter(F.col("entry_date") <= F.date_sub(as_of, EMBARGO_DAYS))
        .join(known, "account_id", "left")
        .filter(due)
        .drop("_known")
    )


def mapped_addresses(
    accounts: DataFrame, rules: DataFrame, location_npis: Sequence[str] = ()
) -> DataFrame:
    """Each account with the postal address its payor, plan or location maps to.

    ``accounts``: ``(account_id, npi, payor_id, plan_id)``; ``rules``: ``(map_to, mapped_payor_id,
    mapped_plan_id, payor_address)``. The rule kinds are Payor, Plans, Payor or plan, Payor and
    Location?. Each way to satisfy a rule is one equi-join, and the first rule in that order wins;
    a join on the whole "or" would compare every account with every rule.
    """
    kinds = {
        "Payor": (("payor_id", "mapped_payor_id"), ("plan_id", "mapped_plan_id")),
        "Plans": (("plan_id", "mapped_plan_id"),),
        "Payor or plan": (("plan_id", "mapped_plan_id"), ("payor_id", "mapped_payor_id")),
        "Payor and Location?": (("payor_id", "mapped_payor_id"),),
    }
    keys = accounts.select("payor_id", "plan_id", "npi").distinct()
    found = []
    for i, (kind, ways) in enumerate(kinds.items()):
        chosen = rules.filter(F.col("map_to") == kind)
        for own, mapped in ways:
            # one address per mapped id before the join: rules repeat ids
            target = chosen.groupBy(F.col(mapped).alias(own)).agg(
                F.min("payor_address").alias("mapped_address")
            )
            source = keys
            if kind == "Payor and Location?":
                source = keys.filter(F.col("npi").cast("string").isin(*location_npis))
            found.append(
                source.join(target, own).select(
                    "payor_id", "plan_id", "npi", F.lit(i).alias("_rule"), "mapped_address"
                )
            )
    matched = reduce(DataFrame.unionByName, found)
    best = top_per(
        matched,
        ["payor_id", "plan_id", "npi"],
        [F.col("_rule"), F.col("mapped_address")],
        1,
    ).drop("_rule")
    # an account has one row per provider; the lowest payor and plan decide among several
    chosen = top_per(
        accounts, ["account_id", "npi"], [F.col("payor_id"), F.col("plan_id")], 1
    )
    b = best.select(
        F.col("payor_id").alias("_p"), F.col("plan_id").alias("_l"), F.col("npi").alias("_n"),
        "mapped_address",
    )
    on = (
        chosen["payor_id"].eqNullSafe(b["_p"])
        & chosen["plan_id"].eqNullSafe(b["_l"])
        & chosen["npi"].eqNullSafe(b["_n"])
    )
    return chosen.join(b, on, "left").drop("_p", "_l", "_n")


def observation_to_inpatient(
    events: DataFrame,
    is_observation: Column,
    is_inpatient: Column,
    require_day2: bool = False,
) -> DataFrame:
    """Encounters that arrive under observation, with the day after as day 2.

    ``events``: ``(patient_id, encounter_id, account_id, event_ts)``. Arrival is the encounter's
    first event. What happened per day is aggregated first, so an encounter with very many events
    is a few rows, and arrival day and next day are then looked up in those.
    """
    keys = ["patient_id", "encounter_id", "account_id"]
    days = events.groupBy(*keys, F.to_date("event_ts").alias("day")).agg(
        F.max(F.coalesce(is_observation, F.lit(False))).alias("observed"),
        F.max(F.coalesce(is_inpatient, F.lit(False))).alias("admitted"),
    )
    arrival = days.groupBy(*keys).agg(F.min("day").alias("day1_arrival_date"))
    placed = days.join(arrival, keys)
    next_day = F.date_add("day1_arrival_date", 1)
    flags = placed.groupBy(*keys, "day1_arrival_date").agg(
        F.max(F.col("observed") & (F.col("day") == F.col("day1_arrival_date"))).alias("day1"),
        F.max(F.col("admitted") & (F.col("day") == next_day)).alias("day2"),
    )
    kept = flags.filter("day1 and day2" if require_day2 else "day1")
    return kept.select(
        "encounter_id", "account_id", "day1_arrival_date", next_day.alias("day2_ip_date")
    )


def within_span(events: DataFrame, ts: str, spans: DataFrame, column: str) -> DataFrame:
    """Events between the least and greatest value of a column of another table."""
    low = spans.agg(F.min(column)).scalar()
    high = spans.agg(F.max(column)).scalar()
    return events.filter(F.col(ts).between(low, high))
