"""Quality rules: a table of thresholds compiled into one projection.

A rule bounds one measure by a share of another, in whole numbers, so the verdict is exact. All
measures are built-in functions over the whole text; the plan is a scan and a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import SPACE_RUN, text_of

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# Frequent short words of the languages served.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this",
    "to", "was", "with",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "pour", "que", "qui", "sur", "un",
    "une",
    "al", "con", "del", "el", "las", "lo", "los", "no", "para", "por", "se", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """``per * measure`` must lie from ``low * base`` to ``high * base`` (either bound may be open)."""

    name: str
    measure: str
    base: str
    low: int | None = None
    high: int | None = None
    per: int = 100


# The first two hold whatever the table says further.
BASE_RULES = (
    Rule("too_few_words", "n_words", "one", low=50, per=1),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "word_chars", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=30),
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words in order; no empty ones."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more.

    The windows are sorted with their places, so equal ones are neighbours; the places of those are
    sorted again, and each covers what the next does not. n log n in the words of a text.
    """

    def places(a: Column) -> Column:
        def window(i: Column) -> Column:
            text = F.concat_ws(" ", *[F.get(a, i + k) for k in range(width)])
            return F.struct(text.alias("w"), i.alias("i"))

        n = F.size(a) - (width - 1)
        return F.when(n < 2, F.array().cast("array<struct<w:string,i:int>>")).otherwise(
            # sort_array compares by the type's own order, array_sort by an expression for each pair
            F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), window))
        )

    def repeated(s: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(s, i - 1)["w"])
            after = F.get(s, i + 1)["w"]
            return F.when(before.eqNullSafe(x["w"]) | after.eqNullSafe(x["w"]), x["i"])

        return F.sort_array(F.filter(F.transform(s, again), lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x)

    return let(words, lambda a: let(places(a), lambda s: let(repeated(s), covered)))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    bare = F.regexp_replace(text, SPACE_RUN, "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
    }


def breaks(rule: Rule) -> Column:
    value, base = F.col(rule.measure) * rule.per, F.lit(1) if rule.base == "one" else F.col(rule.base)
    low = F.lit(False) if rule.low is None else value < base * rule.low
    high = F.lit(False) if rule.high is None else value > base * rule.high
    return low | high


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    base_rules: tuple[Rule, ...] = BASE_RULES,
) -> DataFrame:
    """Per document its measures, base_failed, kept and ``broken``, the names of the rules it breaks.

    Null or empty text has no words and fails. Repeated rows: one result each. Empty table: no rows.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # words and lines are columns of their own, so that each text is split once
    split = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text")).select(
        "doc_id", "text", words_of(text).alias("words"), lines.alias("lines")
    )
    found = measures(text, F.col("words"), F.col("lines"))
    measured = split.select("doc_id", *[c.alias(n) for n, c in found.items()])
    named = [F.when(breaks(r), F.lit(r.name)) for r in (*base_rules, *rules)]
    failed = F.lit(False)
    for rule in base_rules:
        failed = failed | breaks(rule)
    return measured.withColumns(
        {"base_failed": failed, "broken": F.array_compact(F.array(*named))}
    ).withColumn("kept", F.size("broken") == 0)
