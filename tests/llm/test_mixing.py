import random
import re

import pytest
from pyspark.sql import functions as F

from caseflow.llm import mixing
from tests.llm.frames import AWKWARD, frame, prose


def water(sizes, weights, share, most):
    """By rounds: clamp what is above its cap, deal the rest anew."""
    budget, open_, out = share * sum(sizes), set(range(len(sizes))), {}
    while open_:
        level = budget / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not over:
            return [out.get(i, level * weights[i]) for i in range(len(sizes))]
        for i in over:
            out[i] = most * sizes[i]
            budget -= out[i]
            open_.discard(i)
    return [out[i] for i in range(len(sizes))]


def rows():
    r = random.Random(8)
    hot = [(i, prose(r, r.randrange(1, 60)), "en", "hot") for i in range(100, 400)]
    rest = [(i, prose(r, r.randrange(1, 60)), "en", r.choice(["b", "c", "ü", None])) for i in range(400, 520)]
    return AWKWARD + hot + rest


@pytest.mark.parametrize("share,most", [(1.5, 2.0), (0.5, 1.0), (1.9, 2.0), (3.0, 4.0)])
def test_targets_and_taken(spark, share, most):
    data = rows()
    found = mixing.mix(frame(spark, data).repartition(5), share=share, max_epochs=most).collect()
    assert len(found) == len(data)
    sizes = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = [(3, 1, 2)[i % 3] for i in range(len(order))]
    want = dict(zip(order, water([sizes[s] for s in order], weights, share, most), strict=True))
    taken, largest = {}, {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] <= most * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in order:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_reruns_and_layout(spark):
    docs = frame(spark, rows())
    a, b = (sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (docs.repartition(7), docs.coalesce(1)))
    assert a == b


@pytest.mark.parametrize("share", [0.4, 1.5, 1.9])
def test_rows_are_repeated_as_often_as_the_mix_says(spark, share):
    """Rows without id, equal ids with equal and other texts, and repeated rows too."""
    r = random.Random(9)
    data = rows() + [(None, prose(r, 4), "en", "u") for _ in range(100)] + [(None, "one two", "en", "v")] * 41
    data += [(5, f"{prose(r, 3)}", "en", "w") for _ in range(30)] + [(6, "a b c", lang, "w") for lang in ("en", "de") * 20]
    docs = frame(spark, data).repartition(5)
    left = mixing.mixed(docs, share=share)
    assert left.columns == docs.columns
    want, got = {}, {}
    for x in mixing.mix(docs, share=share).collect():
        key = (x["doc_id"], x["source"], x["text_hash"])
        want[key] = want.get(key, 0) + x["copies"]
    for x in left.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit("")))).collect():
        got[tuple(x)] = got.get(tuple(x), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    # rows that differ in other columns only are each taken
    if share > 1:
        assert {x["lang"] for x in left.filter("doc_id = 6").collect()} == {"en", "de"}


@pytest.mark.parametrize("data", [[], [(1, None, None, None)], [(1, "", "en", "a"), (2, None, "en", "b")]])
def test_nothing_to_mix(spark, data):
    found = mixing.mix(frame(spark, data)).collect()
    assert [(r["target"], r["taken"]) for r in found] == [(0.0, 0)] * len(data)
