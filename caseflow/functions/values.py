"""Numbers, codes and name matching."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions.text import stripped

LARGEST = sys.float_info.max
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def safe_double(text: Column) -> Column:
    """A number out of result text such as ``<5`` or ``>1,200``; null where there is none.

    NaN and infinity count as no number, so that no comparison depends on how an engine
    orders them.
    """
    bare = stripped(F.translate(text.cast("string"), ",<>", ""))
    number = bare.try_cast("double")
    return F.when(bare.rlike(NUMERIC) & (F.abs(number) <= LARGEST), number)


@dataclass(frozen=True)
class Matcher:
    """Name rule: any keyword and no exclusion, both as substrings of the lower-cased name."""

    keywords: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    kind: str = "lab"


def _has(name: Column, word: str, whole_word: bool) -> Column:
    return name.rlike(rf"\b\Q{word}\E\b") if whole_word else name.contains(word)


def any_of(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def matches(name: Column, matcher: Matcher, whole_word: bool = False, lowered: bool = False) -> Column:
    lowered = name if lowered else F.lower(name)
    hit = any_of([_has(lowered, word, whole_word) for word in matcher.keywords])
    if matcher.exclude:
        hit = hit & ~any_of([_has(lowered, word, whole_word) for word in matcher.exclude])
    return F.coalesce(hit, F.lit(False))


def categories(
    name: Column,
    matchers: dict[str, Matcher],
    kind: str | None = None,
    whole_word: bool = False,
    exclusive: Sequence[str] = (),
    lowered: bool = False,
) -> Column:
    """The categories a name belongs to, as an array to explode, with nulls for those it does not.

    A name may hit several, but of the ``exclusive`` ones only the first in table order. Nulls are
    left to a filter after the explode: an array function that drops them takes a lambda, and with
    it the whole match would leave generated code.
    """
    entries, taken = [], F.lit(False)
    for category, matcher in matchers.items():
        if kind is not None and matcher.kind != kind:
            continue
        hit = matches(name, matcher, whole_word, lowered)
        if category in exclusive:
            hit, taken = hit & ~taken, taken | hit
        entries.append(F.when(hit, F.lit(category)))
    return F.array(*entries)


def first_category(name: Column, keywords: dict[str, Sequence[str]]) -> Column:
    """The first category, in table order, one of whose keywords the name contains."""
    lowered = F.lower(name)
    result = None
    for category, words in keywords.items():
        hit = any_of([lowered.contains(word) for word in words])
        result = F.when(hit, category) if result is None else result.when(hit, category)
    return result


@dataclass(frozen=True)
class Band:
    """``low <= value < high`` earns ``score``; a bound of None is open."""

    score: int
    low: float | None = None
    high: float | None = None


def band(value: Column, bands: Sequence[Band]) -> Column:
    """Score of the highest band that holds the value, 0 when none does, null for null."""
    result = F.when(value.isNull(), F.lit(None).cast("int"))
    for b in sorted(bands, key=lambda b: -b.score):
        inside = F.lit(True)
        if b.low is not None:
            inside = inside & (value >= b.low)
        if b.high is not None:
            inside = inside & (value < b.high)
        result = result.when(inside, b.score)
    return result.otherwise(0)


def berlin(ratio: Column) -> Column:
    return (
        F.when(ratio.isNull(), None)
        .when(ratio <= 100, "Severe ARDS")
        .when(ratio <= 200, "Moderate ARDS")
        .when(ratio <= 300, "Mild ARDS")
        .otherwise("Normal")
    )


def oxygen_fraction(value: Column) -> Column:
    """FiO2 as a fraction, whether it was charted as 0.4 or as 40."""
    return F.when(value <= 1.0, value).otherwise(value / 100)


def clamp(value: Column, low: int, high: int) -> Column:
    """A whole number from ``low`` to ``high``; bounded first, as no integer type holds every double."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value)).cast("int")


def rating(score: Column) -> Column:
    return F.when(score <= 4, "LOW").when(score <= 7, "MODERATE").when(score.isNotNull(), "HIGH")


def relative_gap(claimed: Column, raw: Column) -> Column:
    """Distance of a claim from a reading relative to the reading, absolute where it is 0."""
    return F.when(raw == 0, F.abs(claimed)).otherwise(
        F.try_divide(F.abs(claimed - raw), F.abs(raw))
    )


def account_number(text: Column) -> Column:
    """``H`` + digits + two trailing characters -> the digits; null for any other form."""
    digits = F.regexp_extract(stripped(text), r"^[Hh](\d+)..$", 1)
    return F.nullif(digits, F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where either has no length."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + F.coalesce(p, F.lit(0.0)))

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def fixed(value: Column, digits: int) -> Column:
    """A double as text with so many digits, rounded half to even on its exact binary value.

    ``round`` works on the shortest decimal form instead, and would make 0.3 of 0.25 and 0.43 of
    0.425, whose binary value lies below.
    """
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def exact_round(value: Column, digits: int) -> Column:
    """Null for infinity; NaN stays."""
    return fixed(value, digits).try_cast("double")


def number_text(value: Column) -> Column:
    """A double as text, as Python and SQL write it: plain from 0.0001 up to 1e16, beyond as ``1e-05``.

    A cast gives the same digits, but turns to the form ``4.0E-4`` below 0.001 and from ten million on.
    """
    text, size = value.cast("string"), F.abs(value)
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.abs(power).cast("string")
    sign, digits = F.when(power < 0, "e-").otherwise("e+"), F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0"))
    return (
        F.when((value == 0) | ((size >= 1e-3) & (size < 1e7)) | F.isnan(value) | (size > LARGEST), text)
        .when((size >= 1e-4) & (size < 1e16), F.concat(plain, F.when(plain.endswith("."), "0").otherwise("")))
        .otherwise(F.concat(mantissa, sign, digits))
    )
