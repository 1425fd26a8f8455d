"""Rows the operators must cope with: nulls in every column, empty and repeated rows, clashing names."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names the operators use inside
        T.StructField("digest", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("node", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("x", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(random, n):
    return " ".join(random.choice(WORDS) + str(random.randrange(50)) for _ in range(n))


def frame(spark, rows):
    """Rows (doc_id, text[, lang, source]) with the other columns filled."""
    full = [(*r, *([None] * (4 - len(r))), 1, "d", 2, "n", "s", "x", "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, "one two three four five six", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n ", "de", "a"),
    (None, "one two  three\nfour five six", "en", None),
    (None, None, None, "a"),
    (7, "ünïcödé — 漢字 🙂 ok", "xx", "b"),
    (7, "ünïcödé — 漢字 🙂 ok", "xx", "b"),
    (7, "same id, other text", "xx", "b"),
    (9, "x" * 5000, "en", "a"),
]
