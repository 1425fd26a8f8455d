"""Language-model scores by the likelihood of the subword lattice.

A text is its words (ASCII letters lower-cased) and one end. A word's probability is the sum over all
its divisions into pieces of an existing vocabulary, of the product of the pieces' probabilities: a
forward recursion in log space. Pieces never go beyond a word, so a text's log probability is the sum
over its words and the end. Characters no piece spells are spelled by their bytes.

Pieces have probabilities from the training texts: counts of the tokenizer's own division of each
different word, times how often the word occurs, plus one.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import id_field, in_tasks, slices, text_of
from caseflow.sources.sinks import staged

_BLANK = "▁"
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
# Different words a task holds before it hands on their counts.
_HELD = 400_000
# Frequent words whose scores go to every task; all others are joined. Splits the work, not the result.
FREQUENT = 50_000


def words_of(text: str) -> list[str]:
    """Runs of characters other than ASCII white space; bytes are split, as str.split knows more spaces."""
    return [x.decode("utf-8", "replace") for x in text.translate(_LOWER).encode("utf-8", "replace").split()]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    other: set[bytes] = set()

    def given() -> pa.RecordBatch:
        rest = [x for x in other if x not in held]
        words, sums = [*held, *rest], [*held.values(), *([0] * len(rest))]
        held.clear()
        other.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()).cast(pa.string()), pa.array(sums, pa.int64())], names=["word", "n"]
        )

    for part, texts in slices(batches):
        for learn, text in zip(part.column(0).to_pylist(), texts, strict=True):
            found = text.translate(_LOWER).encode("utf-8", "replace").split()
            (held if learn else other).update(found)
            if len(held) + len(other) > _HELD:
                yield given()
    yield given()


def count_words(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """word, n (occurrences in rows where ``train`` holds; 0 for words of other rows only)."""

    rows = docs.select(F.coalesce(train, F.lit(False)).alias("learn"), text_of(text_col).alias("text"))
    return rows.mapInArrow(in_tasks(_word_counts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@functools.cache
def _tokenizer(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model


def _piece_counts(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    model = _tokenizer(vocabulary)
    sums = np.zeros(model.get_piece_size(), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            ids = model.encode(part.column(0).to_pylist(), num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.int64, int(sizes.sum()))
            np.add.at(sums, flat, np.repeat(part.column(1).to_numpy(), sizes))
    found = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums[found])], names=["piece", "n"])


def count_pieces(words: DataFrame, vocabulary: str) -> DataFrame:
    """piece (its id), n: the tokenizer's own division of each word, times the word's count."""

    trained = words.filter("n > 0").select("word", "n")
    return trained.mapInArrow(in_tasks(_piece_counts, vocabulary), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Natural-log probabilities of pieces, and of words over all their divisions."""

    def __init__(self, vocabulary: str, counts: dict[int, int], ends: int) -> None:
        model = _tokenizer(vocabulary)
        usable = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
        total = math.log(sum(counts.get(i, 0) for i in usable) + ends + len(usable) + 1)
        self.pieces: dict[str, float] = {}
        self.bytes: dict[int, float] = {}
        self.characters: dict[str, float] = {}
        for i in usable:
            value = math.log(counts.get(i, 0) + 1) - total
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:-1], 16)] = value
            else:
                self.pieces[model.id_to_piece(i)] = value
        self.longest = max(map(len, self.pieces))
        self.end = math.log(ends + 1) - total

    def _character(self, character: str) -> float:
        """A character by itself: as a piece, if it is one, or by its bytes."""
        value = sum(self.bytes.get(b, -50.0) for b in character.encode("utf-8", "replace"))
        piece = self.pieces.get(character)
        if piece is not None:
            value = max(value, piece) + math.log1p(math.exp(-abs(value - piece)))
        self.characters[character] = value
        return value

    def word(self, word: str) -> float:
        """Forward recursion: the score of a prefix is the log of the sum over the last piece.

        Terms are taken relative to the division that ends in a single character, which there always is.
        """
        text = _BLANK + word
        pieces, longest, characters = self.pieces, self.longest, self.characters
        score = [0.0]
        for stop in range(1, len(text) + 1):
            last = text[stop - 1]
            base = characters.get(last)
            base = score[-1] + (self._character(last) if base is None else base)
            terms = []
            for start in range(stop - longest if stop > longest else 0, stop - 1):
                value = pieces.get(text[start:stop])
                if value is not None:
                    terms.append(score[start] + value - base)
            if terms:
                top = max(0.0, *terms)
                base += top + math.log(math.exp(-top) + sum([math.exp(x - top) for x in terms]))
            score.append(base)
        return score[-1]


def _likelihoods(batches: Iterator[pa.RecordBatch], vocabulary: str, lattice) -> Iterator[pa.RecordBatch]:
    model = Lattice(vocabulary, *lattice.value)
    for batch in batches:
        found = [model.word(x) / math.log(10) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["word", "n", "lp"])


def _scored(
    batches: Iterator[pa.RecordBatch], frequent, end_base: float, end_score: float, end_known: bool
) -> Iterator[pa.RecordBatch]:
    known = frequent.value
    names = ["row", "doc_id", "word", "times", "n_tokens", "n_known", "base", "score"]
    for part, texts in slices(batches):
        words: list[bytes] = []
        times: list[int] = []
        heads, sums = [], []
        for i, text in enumerate(texts):
            found = Counter(text.translate(_LOWER).encode("utf-8", "replace").split())
            base, score, hits = end_base, end_score, int(end_known)
            heads.append(len(words))
            for word, n in found.items():
                value = known.get(word)
                if value is None:
                    words.append(word)
                    times.append(n)
                else:
                    base += n * value[0]
                    score += n * value[1]
                    hits += n
            if len(words) == heads[-1]:
                # a text of frequent words alone: a row that meets no word (it has a blank), so
                # that such rows spread over the tasks
                words.append(b" %d" % i)
                times.append(0)
            sums.append((1 + found.total(), hits, base, score))
        # the first row of a text carries what was summed here
        take = np.repeat(np.arange(len(texts)), np.diff([*heads, len(words)]))
        own = np.zeros((len(words), 4))
        own[heads] = sums
        columns = [part.column(2).take(pa.array(take)), part.column(0).take(pa.array(take))]
        columns += [pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
        columns += [pa.array(own[:, k].astype(np.int64)) for k in (0, 1)] + [pa.array(own[:, k].copy()) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def score_texts(
    docs: DataFrame,
    train: Column,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score; all log10.

    ``base_score`` adds log10((c + 1) / (N + V + 1)) over the tokens, c a token's count, N all and V
    the different tokens of the rows where ``train`` holds. ``score`` is the lattice's.

    Counts cover all rows. The driver holds counts of pieces (at most the vocabulary) and the
    ``FREQUENT`` most frequent words; the scores of all other words are joined by the word, after a
    text's equal words have fallen together. Null or empty text: the end alone. Repeated rows: one
    result each. No training rows: every count is 0. Empty table: no rows.
    """
    spark = docs.sparkSession
    counted = staged(count_words(docs, train, text_col))
    ends = docs.filter(F.coalesce(train, F.lit(False))).count()
    sums = counted.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, distinct = (sums[0] or 0) + ends, sums[1] + (1 if ends else 0)
    pieces = {r[0]: r[1] for r in count_pieces(counted, vocabulary).toLocalIterator()}
    lattice = spark.sparkContext.broadcast((pieces, ends))

    scored = staged(counted.mapInArrow(in_tasks(_likelihoods, vocabulary, lattice), "word string, n long, lp double"))
    top = scored.filter("n > 0").orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect()
    frequent = spark.sparkContext.broadcast({r[0].encode(): (math.log10(r[1] + 1), r[2]) for r in top})
    del top
    end_known = ends > 0
    end_base, scale = math.log10(ends + 1), math.log10(tokens + distinct + 1)
    end_score = Lattice(vocabulary, pieces, ends).end / math.log(10)

    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            id_field(docs, id_col),
            T.StructField("word", T.StringType()),
            *[T.StructField(x, T.LongType()) for x in ("times", "n_tokens", "n_known")],
            *[T.StructField(x, T.DoubleType()) for x in ("base", "score")],
        ]
    )
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    parts = rows.mapInArrow(in_tasks(_scored, frequent, end_base, end_score, end_known), schema).join(scored.withColumnRenamed("n", "c"), "word", "left")
    times, c = F.col("times"), F.coalesce("c", F.lit(0))
    found = parts.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + times * F.log10(c + 1.0)).alias("base"),
        F.sum(F.col("score") + times * F.coalesce("lp", F.lit(0.0))).alias("score"),
    )
    return found.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
