import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import toxicity
from tests.llm.frames import AWKWARD, frame, prose

RUDE = ["scumbag", "rubbish", "dimwit", "vile"]


def corpus(n=240, seed=16):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(r, r.randrange(20, 120)).split()
        toxic = r.random() < 0.25
        for _ in range(r.randrange(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(RUDE) + r.choice(["", ",", "."]))
        rows.append((1000 + i, " ".join(words), "en", "a"))
        labels.append((1000 + i, int(toxic)))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(spark):
    rows, labels = corpus()
    docs, marks = frame(spark, [*rows, *AWKWARD]).repartition(4), label_frame(spark, [*labels, (None, 1), (5, None)])
    found = toxicity.score(docs, marks, F.col("doc_id") % 4 != 0).collect()
    assert len(found) == len(rows) + len(AWKWARD)
    truth = dict(labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["doc_id"] in truth and r["doc_id"] % 4 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["predicted"] == 0 for r in found if r["doc_id"] in (2, 3, 4))


def test_ratios_are_brute_force_s(spark):
    rows, labels = corpus(60)
    truth = dict(labels)
    before = {True: defaultdict(set), False: defaultdict(set)}
    for i, t, *_ in rows:
        own = toxicity.tokens(t).tolist()
        for a, b in zip(["start", *own], own):
            before[bool(truth[i])][b].add(a)
    n = {k: {w: len(s) for w, s in v.items()} for k, v in before.items()}
    total = {k: sum(v.values()) for k, v in n.items()}
    every = n[True].keys() | n[False].keys()
    small = n[min(total, key=lambda k: (total[k], not k))].values()
    once, twice = sum(v == 1 for v in small), sum(v == 2 for v in small)
    off = (once + 0.5) / (once + 2 * twice + 1) / min(total.values())
    both = {w: n[True].get(w, 0) + n[False].get(w, 0) for w in every}
    whole = sum(total.values())
    backoff = sum(min(v, off * whole) for v in both.values()) / whole

    def log_p(w, k):
        shared = backoff * (both[w] + 1) / (whole + len(every) + 1)
        return math.log(max(n[k].get(w, 0) / total[k] - off, 0) + shared)

    marked = frame(spark, rows).join(label_frame(spark, labels), "doc_id")
    words, values = toxicity.ratios(toxicity.continuations(marked.select((F.col("toxic") > 0).alias("toxic"), "text")))
    held = dict(zip(words.tolist(), values.tolist(), strict=True))
    assert len(held) > 4
    for w in every:
        assert held.get(w, 0.0) == pytest.approx(log_p(w, True) - log_p(w, False), abs=1e-9)


def test_toxic_rows_leave(spark):
    rows, labels = corpus()
    docs = frame(spark, [*rows, *AWKWARD])
    marks = label_frame(spark, labels)
    scored = {r["doc_id"] for r in toxicity.score(docs, marks, F.lit(True)).filter("predicted = 1").collect()}
    left = toxicity.without_toxic(docs, marks, F.lit(True))
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(
        str(i) for i, *_ in [*rows, *AWKWARD] if i not in scored
    )


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(1, 1), (7, 0)]])
def test_few_labels(spark, labels):
    found = toxicity.score(frame(spark, AWKWARD), label_frame(spark, labels), F.lit(True)).collect()
    assert len(found) == len(AWKWARD) and {r["predicted"] for r in found} == {0}


def test_bounded_sample(spark):
    rows, labels = corpus()
    kept = toxicity.sample(frame(spark, rows), label_frame(spark, labels), F.lit(True), "doc_id", "text", 10)
    assert {(r["toxic"], r["count"]) for r in kept.groupBy("toxic").count().collect()} == {(True, 10), (False, 10)}


def test_empty_table(spark):
    assert toxicity.score(frame(spark, []), label_frame(spark, []), F.lit(True)).count() == 0
