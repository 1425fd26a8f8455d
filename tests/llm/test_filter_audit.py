import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseflow.llm import filter_audit
from tests.llm.frames import AWKWARD, frame, prose

SPACE = " \t\n\r\x0b\f"


def failed(text):
    words = text.replace("\x1c", "\x00").encode().split()
    return {
        letter
        for letter, fails in {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
        }.items()
        if fails
    }


def duplicate(rows, at):
    """Whether some smaller id has the text; rows without an id come last."""
    own, text = rows[at][0], rows[at][1] or ""
    ids = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
    return bool(ids) and (own is None or min(ids) < own)


def brute(rows, labels):
    """The report, filter by filter over the rows."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = [
        (r[0], r[2] or "", failed(r[1] or "") | ({"E"} if duplicate(rows, i) else set())) for i, r in enumerate(rows)
    ]
    out, shares = {}, Counter()
    for part in {p for _, p, _ in docs}:
        own = [(d, f) for d, p, f in docs if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                out[(part, "".join(order), step)] = (
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in own) - len(gone),
                    sum(f == {letter} for _, f in own),
                    sum(d in good for d, _ in gone),
                    sum(d in toxic for d, _ in gone),
                )
                shares[(part, letter)] += len(gone)
    return {k: (*v, shares[(k[0], k[1][k[2] - 1])]) for k, v in out.items()}


def corpus():
    r = random.Random(3)
    texts = [prose(r, n) for n in (5, 99, 100, 101, 140, 300)]
    texts += [texts[3] + " #", texts[4].upper(), "same " * 120, "A" * 12 + "b" * 108, texts[2] + "\x1c " + "x", "one " * 20_000]
    rows, at = list(AWKWARD), 100
    for _ in range(90):
        rows.append((at, r.choice(texts), r.choice(["en", "de", None]), "a"))
        at += r.randrange(3)  # some ids come twice
    rows += [(None, texts[2], "en", "a")] * 3
    return rows


LABELS = [(i, random.Random(i).choice([0, 1, None]), random.Random(-i).choice([0, 1, None])) for i in range(90, 160)]
LABELS += [(100, 0, 0), (100, 1, 0), (None, 1, 1), (999_999, 1, 1), (1, 1, 1)]
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def report(found):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in found.collect()}


@pytest.mark.parametrize("how", ["plain", "weak hash", "small sketch"])
def test_report_is_brute_force_s(spark, how):
    rows = corpus()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    more = {
        "plain": {},
        "weak hash": {"digest": lambda c: F.pmod(F.xxhash64(c), F.lit(5))},
        "small sketch": {"most": 8},
    }[how]
    found = filter_audit.audit(frame(spark, rows).repartition(3), labels, **more)
    want = brute(rows, LABELS)
    assert len(want) == 600 * len({r[2] or "" for r in rows})
    assert report(found) == want


def test_whole_filters_over_a_failing_table(spark):
    rows = [(i, "x", "en", "a") for i in range(5)]
    found = report(filter_audit.audit(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert found[("en", "EABCD", 1)] == (1, 4, 0, 0, 0, 0, 4 * 60)
    assert found[("en", "ABCDE", 5)] == (0, 0, 4, 0, 0, 0, 4 * 60)


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), labels).count() == 0


def test_sketch_never_clears_a_repeat_and_clears_most_others(spark):
    r = random.Random(5)
    once = [r.randrange(-(2**63), 2**63) for _ in range(20_000)]
    hashes = once + once[:500] + [once[7]] * 1000
    r.shuffle(hashes)
    frame_ = spark.createDataFrame([(h,) for h in hashes], "h long").repartition(6)
    bits = filter_audit.sketch(frame_, filter_audit.sketch_size(len(hashes)))
    repeats = np.array(once[:500])
    assert all(filter_audit.met_again(pa.array(repeats), bits).to_pylist())
    open_ = sum(filter_audit.met_again(pa.array(np.array(once[500:])), bits).to_pylist())
    assert open_ < 0.02 * len(once)


def test_merged_segments_are_the_whole_sketch():
    r = np.random.default_rng(1)
    hashes = r.integers(-(2**63), 2**63, 5000)
    hashes[:700] = hashes[700:1400]
    counters = 1 << 22
    runs = [b for part in np.array_split(hashes, 7) for b in filter_audit._counted([pa.record_batch([pa.array(part)], ["h"])], counters)]
    rows = sorted((x for b in runs for x in b.to_pylist()), key=lambda x: x["segment"])
    whole = np.zeros(counters >> 3, np.uint8)
    size = 1 << (filter_audit.SEGMENT_BITS - 3)
    for batch in filter_audit._merged([pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))], counters):
        for row in batch.to_pylist():
            whole[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    counts = np.bincount(filter_audit._places(hashes, counters).ravel().astype(np.int64), minlength=counters)
    assert np.array_equal(whole, np.packbits(counts > 1, bitorder="little"))
