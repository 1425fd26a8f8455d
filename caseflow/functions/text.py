"""Text: tokens, prefixes, replies in fixed formats, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels that mark missing text, part of the table contract.
NO_NOTE = "No Note Available"
NO_ID = "no id available"
NOT_AVAILABLE = "Not available"
UNKNOWN = "Unknown"

# Words that carry no meaning in diagnosis and guideline names.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "with", "without", "unspecified",
    "other", "cms", "hcc", "of", "in", "on", "disease", "illness",
)


WHITE_SPACE = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    """Without white space at both ends, line ends included; ``trim`` takes off blanks only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, min_length: int = 3) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), " +")
    kept = F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*stop_words))
    return F.array_distinct(kept)


def squeeze(text: Column) -> Column:
    """Whole text lower-cased, with each run of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def opening(text: Column, n: int) -> Column:
    """The first ``n`` characters of the squeezed text: what two letters are compared by."""
    return F.substring(squeeze(text), 1, n)


def character_overlap(a: Column, b: Column) -> Column:
    """Share of equal characters by position over the shorter text; 1 if one contains the other."""
    x, y = squeeze(a), squeeze(b)
    shorter = F.least(F.length(x), F.length(y))
    same = F.zip_with(
        F.split(F.left(x, shorter), ""), F.split(F.left(y, shorter), ""), lambda p, q: p == q
    )
    return (
        F.when(F.coalesce(F.length(a), F.lit(0)) == 0, 0.0)
        .when(F.coalesce(F.length(b), F.lit(0)) == 0, 0.0)
        .when(x.contains(y) | y.contains(x), 1.0)
        .otherwise(F.try_divide(F.size(F.filter(same, lambda e: e)), shorter))
    )


def or_default(text: Column, default: str) -> Column:
    """The text, or the default for null and for empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def shortened(text: Column, n: int, ellipsis: str = "") -> Column:
    """At most ``n`` characters, with a mark where something was left out."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(ellipsis))).otherwise(
        text
    )


def without_fence(reply: Column) -> Column:
    """The inside of the first Markdown code fence, or the whole reply if it has none."""
    inside = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*(?:```|$)", 1)
    return F.when(reply.contains("```"), inside).otherwise(stripped(reply))


def without_leading_fence(reply: Column) -> Column:
    """As ``without_fence``, for replies that may only start with a fence."""
    trimmed = stripped(reply)
    return F.when(trimmed.startswith("```"), without_fence(trimmed)).otherwise(trimmed)


def key_values(reply: Column, unless_none: tuple[str, ...] = ()) -> Column:
    """``KEY: value`` lines as a map of upper-cased keys; the last line of a key wins.

    Of the keys ``unless_none`` lines without a value, or with NONE, do not count.
    """
    lines = F.filter(F.split(reply, "\n"), lambda line: line.contains(":"))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.upper(stripped(F.substring_index(line, ":", 1))).alias("key"),
            stripped(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"),
        ),
    )
    if unless_none:
        empty = lambda x: (x["value"] == "") | (F.upper(x["value"]) == "NONE")
        pairs = F.filter(pairs, lambda x: ~(x["key"].isin(*unless_none) & empty(x)))

    # map_from_entries rejects repeated keys. Sorted by key and place, a key's last entry is the one
    # before another key; n log n in the lines.
    def last(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: ~F.get(ordered, i + 1)["key"].eqNullSafe(x["key"]))

    placed = F.transform(
        pairs, lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x["value"].alias("value"))
    )
    kept = F.element_at(F.transform(F.array(F.array_sort(placed)), last), 1)
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"], x["value"])))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced; braces inside values stay as they are."""
    # Placeholders become private-use marks first, so a value that holds "{x}" is not filled again.
    result = template
    marks = {name: f"\ue000{i}\ue001" for i, name in enumerate(values)}
    for name, mark in marks.items():
        result = F.replace(result, F.lit("{" + name + "}"), F.lit(mark))
    for name, value in values.items():
        result = F.replace(result, F.lit(marks[name]), F.coalesce(value.cast("string"), F.lit("")))
    return result


def cut_template(template: str, names: set[str]) -> list[tuple[str, str | None]]:
    """The template's stretches of text and its ``{name}`` placeholders in order: (text, None), (placeholder, name)."""
    found: list[tuple[str, str | None]] = []
    at = 0
    for match in re.finditer(r"\{(\w+)\}", template):
        if match[1] in names:
            found += [(template[at : match.start()], None), (match[0], match[1])]
            at = match.end()
    found.append((template[at:], None))
    return [x for x in found if x[0]]


def title_of(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def safe_file_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", ""))


def condition_of_file(file_name: Column, prefix: str = "") -> Column:
    """Condition name out of a definition file's name: no extension, lower case, no prefix."""
    base = F.lower(F.regexp_replace(file_name, r"\.[^.]*$", ""))
    if not prefix:
        return base
    return F.when(base.startswith(prefix), F.substring(base, len(prefix) + 1, 1 << 30)).otherwise(
        base
    )


def bold_runs(text: Column) -> Column:
    """``**bold**`` text as ordered runs ``(text, bold)``; the marks are dropped."""
    runs = F.regexp_extract_all(
        text, F.lit(r"(?s)(\*\*.*?\*\*|.+?(?=\*\*.*?\*\*|\z))"), F.lit(1)
    )

    def run(raw: Column) -> Column:
        bold = raw.rlike(r"(?s)^\*\*.*\*\*\z") & (F.length(raw) >= 4)
        inside = F.substring(raw, F.lit(3), F.length(raw) - 4)
        return F.struct(F.when(bold, inside).otherwise(raw).alias("text"), bold.alias("bold"))

    return F.transform(runs, run)


def paragraphs(text: Column) -> Column:
    """Paragraphs split at blank lines, trimmed, without empty ones."""
    parts = F.transform(F.split(text, "\n\n"), lambda p: stripped(p))
    return F.filter(parts, lambda p: p != "")
