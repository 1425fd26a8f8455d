import random
from collections import Counter

import numpy as np
import pytest

from caseflow.llm import near_dedup
from tests.llm.frames import AWKWARD, frame, prose


def shingles(text, width=5):
    words = text.split()
    if not words:
        return Counter()
    span = min(width, len(words))
    return Counter(tuple(words[i : i + span]) for i in range(len(words) - span + 1))


def probability_jaccard(a, b):
    return sum(
        1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys()
    )


def changed(random_, text, share):
    return " ".join(w if random_.random() > share else "new" + str(random_.randrange(10**6)) for w in text.split())


def classes(rows, threshold=0.8):
    own = [shingles(t or "") for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] == own[j] or probability_jaccard(own[i], own[j]) >= threshold - 1e-12:
                parent[top(i)] = top(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(top(i), []).append(i)
    return list(out.values())


def test_similarity_is_the_definition():
    r = random.Random(4)
    for _ in range(60):
        a = " ".join(r.choice("abc") for _ in range(r.randrange(1, 40)))
        b = changed(r, a, 0.1) + " a b c a b c"
        exact = probability_jaccard(shingles(a, 2), shingles(b, 2))
        assert near_dedup.similarity(near_dedup.weighted(a, 2), near_dedup.weighted(b, 2)) == pytest.approx(exact)


def test_signatures_estimate_it():
    r = random.Random(5)
    found, exact = [], []
    for n in (3, 40, 400):
        for _ in range(12):
            a = prose(r, n) + " " + prose(r, 5) * 3
            b = changed(r, a, 0.05)
            x, y = near_dedup.weighted(a, 5), near_dedup.weighted(b, 5)
            found.append((near_dedup.signature(*x, 400) == near_dedup.signature(*y, 400)).mean())
            exact.append(near_dedup.similarity(x, y))
    assert np.abs(np.array(found) - exact).max() < 0.12
    assert abs(np.mean(np.array(found) - exact)) < 0.015


def corpus(n_groups=6):
    """Copies near a base but not near each other, chains, and one large group."""
    r = random.Random(6)
    rows, at = list(AWKWARD), 1000
    for g in range(n_groups):
        base = prose(r, 120)
        for _ in range(40 if g == 0 else 5):
            rows.append((at, changed(r, base, 0.018), "en", "a"))
            at += 1
        rows.append((at, base, "en", "a"))
        at += 1
    chain = prose(r, 150)
    for _ in range(6):
        rows.append((at, chain, "en", "a"))
        at += 1
        chain = changed(r, chain, 0.012)
    for _ in range(20):
        rows.append((at, prose(r, 20) + " " + " ".join(["shared"] + prose(random.Random(7), 25).split()), "en", "b"))
        at += 1
    return rows


def test_classes_are_brute_force_s(spark):
    rows = corpus()
    found = near_dedup.find_near_copies(frame(spark, rows).repartition(4)).collect()
    want = Counter()
    for group in classes(rows):
        ids = [rows[i][0] for i in group]
        known = [i for i in ids if i is not None]
        for i in ids:
            want[(i, min(known) if known else None, len(ids))] += 1
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(classes(rows))


def test_one_of_each_class_stays(spark):
    rows = corpus(2)
    docs = frame(spark, rows)
    left = near_dedup.without_near_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len(classes(rows))


def test_empty_table(spark):
    assert near_dedup.find_near_copies(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7)]
    found = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r["node"]: r["class"] for r in found}
    assert all(got[i] == 1 for i in range(2, 41)) and got[200] == 100 and got[150] == 100
