"""Name rules by the thousand: a table of words meets distinct names through the pieces both are made of.

A profile's few rules are columns (``functions.values``), whose cost is a look for each word at each row.
Here the rules are a table, and a word only looks at names that hold its rarest piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.values import Matcher
from caseflow.sources.sinks import staged

# Characters of a piece; shorter words are a piece by themselves.
PIECE = 3
# Matches are sent to every task if they are no more than this, else rows and matches meet by name.
SMALL = 100_000
# Categories are sent to every task if they are no more than this, else they meet their sets by a shuffle.
TOLD = 2_000_000


def rules_of(spark: SparkSession, matchers: Mapping[str, Matcher], kind: str | None = None) -> DataFrame:
    """A profile's matchers as rules: (category, place, word, excludes)."""
    rows = [
        (category, place, word, excludes)
        for place, (category, matcher) in enumerate(matchers.items())
        if kind is None or matcher.kind == kind
        for words, excludes in ((matcher.keywords, False), (matcher.exclude, True))
        for word in words
    ]
    return spark.createDataFrame(rows, "category string, place int, word string, excludes boolean")


def _pieces(text: Column, length: int) -> Column:
    """The different pieces of a length; empty if the text is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - length + 1))
    found = F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(length))))
    return F.filter(found, lambda x: F.length(x) == length)


def _rule_sets(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules told once for all categories that share them: (_set, _rules), and (_set, category, place)."""
    stated = F.array_sort(F.collect_set(F.struct("word", "excludes")))
    own = staged(rules.filter("word is not null").groupBy("category", "place").agg(stated.alias("_rules")))
    sets = staged(own.select("_rules").distinct().withColumn("_set", F.monotonically_increasing_id()))
    return sets, staged(own.join(sets, "_rules").select("_set", "category", "place"))


def _named_sets(names: DataFrame, sets: DataFrame, whole_word: bool) -> DataFrame:
    """Which sets of rules each distinct name keeps to: (name, _set).

    A word is listed under one of its pieces of three characters, the one that fewest names have, and meets
    the names that have it; a word whose pieces are not all known meets none. What meets is then checked as
    a whole. Words that exclude are looked for in the names their set has met, as one may be in very many.
    """
    known = staged(names.filter("name is not null").select("name", F.lower("name").alias("_low")).distinct())

    def holds(word: Column) -> Column:
        low = F.col("_low")
        return F.rlike(low, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\b"))) if whole_word else F.contains(low, word)

    out = F.transform(F.filter("_rules", lambda r: r["excludes"] & (r["word"] != "" if whole_word else F.lit(True))), lambda r: r["word"])
    asked = sets.select("_set", out.alias("_out"), F.explode("_rules").alias("_r")).filter("not _r.excludes")
    asked = asked.select("_set", "_out", F.col("_r.word").alias("word"))
    words = asked.select("word").filter("word <> ''").distinct()
    each = f"transform(sequence(1, greatest(1, length(word) - {PIECE - 1})), i -> substr(word, i, {PIECE}))"
    own = staged(words.select("word", F.explode(F.expr(each)).alias("_piece")))
    # at most PIECE rows
    lengths = sorted(r[0] for r in own.select(F.length("_piece")).distinct().collect())
    pieces = F.concat(F.array().cast("array<string>"), *[_pieces(F.col("_low"), n) for n in lengths])
    cut = known.select("name", "_low", F.explode(pieces).alias("_piece"))
    counts = cut.groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = (
        own.join(counts, "_piece", "left")
        .groupBy("word")
        .agg(F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), "_piece")).alias("_piece"))
    )
    met = cut.join(staged(rarest), "_piece").filter(holds(F.col("word"))).select("name", "_low", "word").join(asked, "word")
    if not whole_word:  # the empty word is in every name
        empty = known.select("name", "_low", F.lit("").alias("word"))
        met = met.unionByName(empty.join(asked.filter("word = ''"), "word"))
    return met.filter(~F.exists("_out", holds)).select("name", "_set").distinct()


def named_categories(
    names: DataFrame, rules: DataFrame, whole_word: bool = False, exclusive: Sequence[str] = ()
) -> DataFrame:
    """Which categories each name belongs to: (name, category), one row each.

    ``names``: ``(name)``; ``rules``: ``(category, place, word, excludes)``. A name belongs to a category
    if it holds one of its words and none that excludes, lower-cased, as ``values.categories`` has it; of the
    ``exclusive`` categories it gets the one of lowest place.

    Only distinct names are looked at, and categories of the same rules are looked for once.
    """
    sets, members = _rule_sets(rules)
    hits = _named_sets(names, sets, whole_word).join(members, "_set")
    if exclusive:
        among = F.col("category").isin(*exclusive)
        first = hits.filter(among).groupBy("name").agg(F.min_by("category", "place").alias("category"))
        return hits.filter(~among).select("name", "category").unionByName(first)
    return hits.select("name", "category")


def with_categories(
    rows: DataFrame, column: str, rules: DataFrame, whole_word: bool = False, exclusive: Sequence[str] = ()
) -> DataFrame:
    """A row for each category that the row's name belongs to, as ``category``; rows without one are dropped.

    Rows meet the sets of rules of their name, and categories are told last, so that no step but the result
    has a row for each name and category.
    """
    names = rows.select(F.col(column).alias("name"))
    if exclusive:
        found = named_categories(names, rules, whole_word, exclusive)
        found, told = staged(found.withColumnRenamed("name", "_name")), None
    else:
        sets, told = _rule_sets(rules)
        found = staged(_named_sets(names, sets, whole_word).withColumnRenamed("name", "_name"))
        if told.count() <= TOLD:
            told = F.broadcast(told)
    if found.count() <= SMALL:
        found = F.broadcast(found)
    named = rows.join(found, F.col(column) == F.col("_name")).drop("_name")
    return named if told is None else named.join(told.drop("place"), "_set").drop("_set")
