"""Guideline documents for diagnoses, by code and by words in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import tokens
from caseflow.operators.slices import same_key
from caseflow.operators.windows import top_per
from caseflow.sources.sinks import staged

# Worth of a match by diagnosis code, procedure code, procedure name, words.
DIAGNOSIS_CODE, PROCEDURE_CODE, PROCEDURE_NAME, WORDS = 1.0, 0.8, 0.6, 0.2

FACTS = ("dx_code", "dx_name", "proc_code", "px_name")
# A set of words is common if more names and more documents than this hold it.
COMMON = 256


def best_sharing(asked: DataFrame, documents: DataFrame, common: int = COMMON) -> DataFrame:
    """For each row of ``asked`` the document of its group that shares the most of its words.

    ``asked``: ``(group, name, words, needs_word)``, one row per group, name and ``needs_word``;
    ``documents``: ``(group, file_name, words)``. Words are sorted and distinct. Ties go to the
    document of more words, then to the lower file name. Gives ``(group, name, needs_word,
    file_name, n_shared, n_tokens)``; rows without a document have none.

    No names meet all documents of a common word. Both sides are listed under what they may share,
    at first their group (rows that need a word: each word). If few names or few documents
    are listed under an item, they all meet, and each name finds there whatever it shares with them.
    If both are many, names meet only the item's head, the document of most words, and both are
    listed anew under the item and one more of their words. That is exact: let a name and its best
    document share the words I. If I is common, so are all its subsets, the name comes to I, and the
    head of I shares as many words and has as many. If not, the two meet at the first subset of I
    that is not common. So an item brings at most ``common`` times the rows listed under it.
    """
    documents = staged(documents.withColumn("n_tokens", F.size("words")))
    asked = staged(asked)
    singles = F.transform("words", lambda w: F.array(w))
    start = F.when(F.col("needs_word"), singles).otherwise(F.array(F.array().cast("array<string>")))
    left = asked.select("*", F.explode(start).alias("item"))
    every = F.concat(F.array(F.array().cast("array<string>")), singles)
    right = documents.select("*", F.explode(every).alias("item"))
    key = ["group", "item"]
    order = F.struct(-F.col("n_tokens"), F.col("file_name"))
    found = None
    while True:
        listed = (
            left.groupBy(*key)
            .agg(F.count("*").alias("_names"))
            .join(
                right.groupBy(*key).agg(
                    F.count("*").alias("_documents"),
                    F.min_by(F.struct("file_name", "words", "n_tokens"), order).alias("_head"),
                ),
                key,
            )
            .withColumn("_common", F.least("_names", "_documents") > common)
        )
        listed = staged(listed)
        few = listed.filter("not _common").select(*key)
        theirs = right.join(few, key, "left_semi").select(
            *key, "file_name", "n_tokens", F.col("words").alias("_words")
        )
        heads = listed.filter("_common").select(
            *key, "_head.file_name", "_head.n_tokens", F.col("_head.words").alias("_words")
        )
        met = left.join(theirs, key).unionByName(left.join(heads, key))
        met = met.select(
            "group", "name", "needs_word", "file_name",
            F.size(F.array_intersect("words", "_words")).alias("n_shared"), "n_tokens",
        )
        found = met if found is None else found.unionByName(met)
        many = listed.filter("_common").select(*key)
        if many.isEmpty():
            break
        left, right = _longer(left, many), _longer(right, many)
    best = [F.col("n_shared").desc(), F.col("n_tokens").desc(), F.col("file_name")]
    return top_per(found, ["group", "name", "needs_word"], best, 1)


def _longer(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows under each of the items, extended by each of their words that comes after the item's."""
    key = ["group", "item"]
    last = F.try_element_at("item", F.lit(-1))
    more = F.filter("words", lambda w: last.isNull() | (w > last))
    names = [c for c in rows.columns if c != "item"]
    grown = rows.join(items, key, "left_semi").select(*names, "item", F.explode(more).alias("_more"))
    return grown.select(*names, F.concat("item", F.array("_more")).alias("item"))


def best_guidelines(diagnoses: DataFrame, guidelines: DataFrame, common: int = COMMON) -> DataFrame:
    """Each diagnosis row with its best guideline document, or none.

    ``diagnoses``: ``(…, dx_code, dx_name, proc_code, px_name)``; ``guidelines``:
    ``(file_name, codes)``, the codes as a comma-separated list. A document is a candidate if it
    lists the diagnosis or procedure code or shares a word with the diagnosis name.

    Matching runs on distinct facts, not on accounts, so its cost follows the dictionaries. The
    "or" becomes searches within groups: a group per code, and one of all documents, in which a
    word must be shared. The best match is joined back to all rows at the end.
    """
    none = F.array().cast("array<string>")

    def words(name: str):
        return F.coalesce(F.array_sort(tokens(F.col(name))), none).alias("words")

    facts = staged(diagnoses.select(*FACTS).distinct().select("*", words("dx_name")))
    documents = guidelines.select("file_name", words("file_name"), "codes")
    codes = F.transform(F.split("codes", ","), lambda x: F.concat(F.lit("code "), F.trim(x)))
    groups = F.array_distinct(F.concat(F.array(F.lit("")), F.coalesce(codes, none)))
    # documents of equal words in a group stand for one
    listed = (
        documents.select("file_name", "words", F.explode(groups).alias("group"))
        .filter("group is not null")
        .groupBy("group", "words")
        .agg(F.min("file_name").alias("file_name"))
    )

    def group(code: str):
        return F.concat(F.lit("code "), F.col(code))

    ways = (
        (group("dx_code"), False, DIAGNOSIS_CODE),
        (group("proc_code"), False, PROCEDURE_CODE),
        (group("px_name"), True, PROCEDURE_NAME),
        (F.lit(""), True, None),
    )
    wanted = facts.select(
        *FACTS,
        "words",
        F.explode(
            F.array(
                *[
                    F.struct(g.alias("group"), F.lit(needs).alias("needs_word"), F.lit(worth).cast("double").alias("worth"))
                    for g, needs, worth in ways
                ]
            )
        ).alias("way"),
    ).select(*FACTS, "words", "way.*")
    wanted = wanted.filter("group is not null")
    asked = wanted.select("group", F.col("dx_name").alias("name"), "words", "needs_word").distinct()
    found = best_sharing(asked, listed, common).withColumnRenamed("name", "dx_name")
    matched = same_key(wanted, found, ["group", "dx_name", "needs_word"], "inner")
    similarity = F.coalesce(F.try_divide("n_shared", F.size("words")), F.lit(0.0))
    candidates = matched.select(
        *FACTS,
        "file_name",
        F.when(F.col("worth").isNotNull(), F.substring("group", len("code ") + 1, 1 << 30)).alias("guideline_code"),
        similarity.alias("similarity"),
        F.coalesce("worth", WORDS * similarity).alias("combined"),
        "n_tokens",
    )
    order = [
        F.col("combined").desc(),
        F.col("similarity").desc(),
        F.col("n_tokens").desc(),
        F.col("file_name"),
        F.col("guideline_code"),
    ]
    return same_key(diagnoses, top_per(candidates, FACTS, order, 1), FACTS, "left")
