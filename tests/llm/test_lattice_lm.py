import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from caseflow.llm import lattice_lm
from tests.llm.frames import AWKWARD, frame, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def divisions(text):
    if not text:
        yield ()
    for k in range(1, len(text) + 1):
        for rest in divisions(text[k:]):
            yield (text[:k], *rest)


def test_words_sum_all_divisions():
    model = lattice_lm.Lattice(MODEL, {300: 50, 1000: 7, 5000: 3}, 10)
    for word in ("cat", "there", "naïve", "漢x", "🙂"):
        total = 0.0
        for parts in divisions("▁" + word):
            value = 1.0
            for p in parts:
                one = math.exp(model.pieces[p]) if p in model.pieces else 0.0
                if len(p) == 1:  # a character also has its spelling by bytes
                    one += math.exp(sum(model.bytes[b] for b in p.encode()))
                value *= one
            total += value
        assert model.word(word) == pytest.approx(math.log(total))


def test_probabilities_of_pieces_sum_to_one():
    model = lattice_lm.Lattice(MODEL, {300: 50, 1000: 7}, 10)
    every = [*model.pieces.values(), *model.bytes.values(), model.end]
    assert math.fsum(map(math.exp, every)) == pytest.approx(1.0)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.mark.parametrize("frequent", [0, 3, 50_000])
def test_scores_are_brute_force_s(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice_lm, "FREQUENT", frequent)
    r = random.Random(13)
    rows = [*AWKWARD, *((100 + i, prose(r, r.randrange(40)).title(), "en", "a") for i in range(40))]
    docs = frame(spark, rows).repartition(3)
    train = F.col("doc_id") % 3 != 0
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    counts, ends = Counter(), 0
    for i, t, *_ in rows:
        if i is not None and i % 3 != 0:
            counts.update(words(t))
            ends += 1
    tokens, distinct = sum(counts.values()) + ends, len(counts) + 1
    library = lattice_lm._tokenizer(MODEL)
    pieces = Counter()
    for w, n in counts.items():
        for p in library.encode(w):
            pieces[p] += n
    model = lattice_lm.Lattice(MODEL, pieces, ends)
    want = Counter()
    for i, t, *_ in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 1) / (tokens + distinct + 1)) for w in own)
        base += math.log10((ends + 1) / (tokens + distinct + 1))
        score = (sum(map(model.word, own)) + model.end) / math.log(10)
        want[(i, len(own) + 1, sum(counts[w] > 0 for w in own) + 1, tokens, round(base, 6), round(score, 6))] += 1
    found = lattice_lm.score_texts(docs, train, MODEL).collect()
    assert Counter((*r[:4], round(r[4], 6), round(r[5], 6)) for r in found) == want


def test_no_training_rows(spark):
    found = lattice_lm.score_texts(frame(spark, [(1, "a b"), (2, None)]), F.lit(False), MODEL).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert all(r["base_score"] == 0 and r["score"] < 0 for r in found)


def test_empty_table(spark):
    assert lattice_lm.score_texts(frame(spark, []), F.lit(True), MODEL).count() == 0
