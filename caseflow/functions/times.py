"""Time: microseconds, formats, encounter arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions.text import stripped

SECOND = 1_000_000
HOUR = 3600 * SECOND
MONTH = 30 * 24 * 60 * 60 * 1_000_000
DAY = 24 * HOUR

# The forms in which notes state a time, in the order they are tried.
CLAIM_TIME_FORMATS = ("M/d/yyyy H:m", "M/d/yyyy", "yyyy-M-d H:m", "yyyy-M-d")


def _shape(pattern: str) -> str:
    """What a text of the format looks like: four digits for the year, one or two elsewhere."""

    def digits(field: re.Match) -> str:
        return r"\d{4}" if field.group() == "yyyy" else r"\d{1,2}"

    return "^" + re.sub("yyyy|[MdHm]", digits, pattern) + "$"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch as an exact long; accepts both timestamp types."""
    return F.unix_micros(ts.cast("timestamp"))


def stamp(us: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_micros(us), pattern)


def parsed(text: Column, formats: tuple[str, ...] = CLAIM_TIME_FORMATS) -> Column:
    """The first format that reads the text decides; null when none does.

    A format is tried only on text of its shape: a failed parse costs an exception per row.
    """
    bare = stripped(text)
    return F.coalesce(
        *[F.when(bare.rlike(_shape(f)), F.try_to_timestamp(bare, F.lit(f))) for f in formats]
    )


def recorded(text: Column) -> Column:
    """A flowsheet time: the first 19 characters, to the second."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def us_date(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy")


def service_dates(start: Column, end: Column, sep: str = "-") -> Column:
    return F.concat(us_date(start), F.lit(sep), us_date(end))


def midnights(start: Column, end: Column) -> Column:
    return F.datediff(end.cast("date"), start.cast("date"))


def age(birth: Column, on: Column) -> Column:
    return F.floor(F.datediff(on.cast("date"), birth.cast("date")) / 365.25)


def timing(at: Column, start: Column, end: Column) -> Column:
    """BEFORE, DURING or AFTER an encounter; an open encounter has no AFTER."""
    return (
        F.when(at < start, "BEFORE")
        .when((at >= start) & (end.isNull() | (at <= end)), "DURING")
        .otherwise("AFTER")
    )
