import random
from collections import Counter

import numpy as np
import pytest

from caseflow.llm import language_id
from tests.llm.frames import AWKWARD, frame

SYLLABLES = {"aa": ["the", "ing", "ou", "er"], "bb": ["sch", "ung", "ein", "der"], "cc": ["eau", "ment", "le", "é"]}


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    marked = "\x01" + "\x01".join(words) + "\x01" if words else ""
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            gram = marked[i : i + n]
            if "\x01" not in gram[1:-1] and gram != "\x01":
                out[gram] += 1
    return out


def code(gram):
    return sum(ord(c) << (21 * i) for i, c in enumerate(gram))


@pytest.mark.parametrize("text", ["", "a", "Ab cd", "x1y  z", "Élan — 漢字!", "a b", *(t for _, t, *_ in AWKWARD if t)])
def test_ngrams(text):
    assert Counter(language_id.ngrams(text).tolist()) == Counter({code(g): n for g, n in brute_grams(text).items()})


def corpus():
    r = random.Random(10)
    rows = []
    for i in range(90):
        lang = ("aa", "bb", "cc")[i % 3]
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(8, 60))]
        rows.append((100 + i, " ".join(words), lang, "s"))
    return rows


def test_profiles_and_distances_are_brute_force_s(spark):
    rows, size = corpus(), 50
    profiles = language_id.learn(frame(spark, rows).repartition(4), size)
    ranks = {}
    for lang in SYLLABLES:
        total = sum((brute_grams(t) for _, t, x, _ in rows if x == lang), Counter())
        order = sorted(total, key=lambda g: (-total[g], code(g)))[:size]
        ranks[lang] = {code(g): i for i, g in enumerate(order)}
    assert {(r["lang"], r["code"], r["rank"]) for r in profiles.collect()} == {
        (x, c, i) for x, v in ranks.items() for c, i in v.items()
    }
    for r in language_id.predict(frame(spark, rows), profiles, size).collect():
        grams = brute_grams(next(t for i, t, *_ in rows if i == r["doc_id"]))
        own = sorted(grams, key=lambda g: (-grams[g], code(g)))[:size]
        away = {
            x: sum(min(size, abs(i - v[code(g)])) if code(g) in v else size for i, g in enumerate(own))
            for x, v in ranks.items()
        }
        best = min(sorted(away), key=away.get)
        assert (r["lang_pred"], r["score"]) == (best, pytest.approx(1 - away[best] / (size * len(own))))


def test_held_out_accuracy(spark):
    rows = corpus()
    profiles = language_id.learn(frame(spark, rows[:60]))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(frame(spark, rows[60:]), profiles).collect()}
    assert np.mean([found[i] == lang for i, _, lang, _ in rows[60:]]) > 0.95


def test_undetermined(spark):
    docs = frame(spark, [*AWKWARD, (50, "123 !?", "en", "a")])
    profiles = language_id.learn(docs)
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(docs, profiles).collect()}
    for i in (2, 3, 4, 50):
        assert (i, "und", 0.0) in found
    none = language_id.predict(docs, language_id.learn(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == len(AWKWARD) + 1


def test_empty_table(spark):
    docs = frame(spark, [])
    assert language_id.predict(docs, language_id.learn(docs)).count() == 0
