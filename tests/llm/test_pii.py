import random
import re

import numpy as np
import pytest

from caseflow.llm import pii
from tests.llm.frames import AWKWARD, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = [int(c) for c in found if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {
        k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in PATTERNS.items()
    }


def base(spark, texts):
    rows = pii.candidates(frame(spark, list(enumerate(texts))), "doc_id", "text").collect()
    return {r["doc_id"]: {k: [(x["start"], x["stop"]) for x in r[f"base_{k}"]] for k in pii.KINDS} for r in rows}


def test_base_spans(spark):
    r = random.Random(11)
    bits = ["a", "b.c", "@", ".", "@x.y", "1", "25", "255", "256", "007", "+", "+1", " ", "-", "(", ")", "555", "é", "🙂",
            "4111 1111 1111 1111", "4111111111111111", "me@mail.org", "1.2.3.4", "_", "%", "\n", "0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(400)]
    texts += [t for _, t, *_ in AWKWARD]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (269) 555-3296 45", "1.2.3.99999999999999999999"]
    found = base(spark, texts)
    for i, t in enumerate(texts):
        assert found[i] == brute(t), t


def test_many_matches_and_long_runs(spark):
    texts = ["é me@mail.org " * 700, "a" * 200_000 + "@", "1" * 200_000, ".".join(["1"] * 5000), "a.b" * 30_000 + "@c"]
    found = base(spark, texts)
    for i in (0, 3):
        assert found[i] == brute(texts[i])
    assert found[1]["email"] == found[2]["ip"] == []


def test_added_spans(spark):
    r = random.Random(12)
    number = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    texts = [f"please call +1 ({number(3)}) {number(3)}-{number(4)} now" for _ in range(300)]
    texts += [f"row +1 {number(2)}-{number(2)}" for _ in range(40)]  # too few digits: fails the check
    texts += ["please call (269) 555-3296 now", "clean words only", "version 2.0 of 1999"]
    rows = pii.find_spans(frame(spark, list(enumerate(texts)))).collect()
    found = {x["doc_id"]: [y["found"] for y in x["added_phone"]] for x in rows}
    assert found[340] == ["(269) 555-3296"]
    assert found[341] == found[342] == []
    assert all(len(x["base_phone"]) == 1 for x in rows if x["doc_id"] < 300)


def test_trees_learn_and_thresholds_hold():
    r = np.random.default_rng(0)
    table = np.unique(r.integers(0, 3, (200, len(pii.FEATURES))), axis=0)
    good = (table[:, 0] > 0) & (table[:, 3] < 2)
    yes, no = np.where(good, 50.0, 1.0), np.where(good, 1.0, 50.0)
    model = pii.calibrated(pii.boost(table, yes, no), table, yes, no, 0.9)
    above = model.values(table) >= model.threshold
    assert (above == good).mean() > 0.95
    assert yes[above].sum() >= 0.9 * (yes[above].sum() + no[above].sum())


@pytest.mark.parametrize(("yes", "no", "has"), [(4, 0, True), (19, 0, True), (19, 1, True), (3, 0, False), (12, 4, False), (0, 0, False)])
def test_few_spans_have_a_threshold(yes, no, has):
    table = np.zeros((1, len(pii.FEATURES)), int)
    counts = np.array([float(yes)]), np.array([float(no)])
    assert (pii.calibrated(pii.boost(table, *counts), table, *counts, 0.9).threshold is not None) == has


def test_small_corpus_adds_spans(spark):
    r = random.Random(14)
    number = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    texts = [f"please call +1 ({number(3)}) {number(3)}-{number(4)} now" for _ in range(40)]
    texts += ["please call (269) 555-3296 now", "from 152.143.123.204 and 13.149.130.89"]
    rows = pii.find_spans(frame(spark, list(enumerate(texts)))).collect()
    assert [y["found"] for x in rows for y in x["added_phone"]] == ["(269) 555-3296"]


def test_trees_as_columns_give_the_same(spark):
    from pyspark.sql import functions as F

    table = np.array([[i, i % 3, i % 2, 0, 1, 2, i % 4] for i in range(20)])
    yes, no = np.arange(20.0), np.arange(20.0)[::-1]
    model = pii.boost(table, yes, no)
    rows = spark.createDataFrame([tuple(map(int, x)) for x in table], list(pii.FEATURES)).coalesce(1)
    total = F.lit(model.start)
    for tree in model.trees:
        total = total + tree.column({n: F.col(n) for n in pii.FEATURES})
    assert [x[0] for x in rows.select(total).collect()] == pytest.approx(model.values(table).tolist())


def further(spark, texts, kind):
    rows = pii.candidates(frame(spark, list(enumerate(texts))), "doc_id", "text").collect()
    for r in rows:
        for x in [*r[f"base_{kind}"], *r[f"more_{kind}"]]:
            assert texts[r["doc_id"]][x["start"] : x["stop"]] == x["found"]
        places = [(x["start"], x["stop"]) for x in r[f"more_{kind}"]]
        assert places == sorted(set(places))
        assert not any(a < d and c < b for a, b in places for c, d in [(x["start"], x["stop"]) for x in r[f"base_{kind}"]])
    return {r["doc_id"]: [x["found"] for x in r[f"more_{kind}"]] for r in rows}


def test_numbers_beside_others_are_candidates(spark):
    phones = ["é. Des +1 (826) 555-4081 190.137.223.204 du", "🙂 +1 (269) 555-3296 ok 0171 5553296, 01 23 45 67 89 10.999.1.2.3.4"]
    found = further(spark, phones, "phone")
    assert "+1 (826) 555-4081" in found[0]
    assert {"0171 5553296", "01 23 45 67 89"} <= set(found[1])
    assert "1.2.3.4" in further(spark, phones, "ip")[1]
    cards = ["ç 7536784127813050 4845168114407329 è", "x 4111 1111 1111 1111 2024 4465758382889437 4465758382889437"]
    found = further(spark, cards, "card")
    assert {"7536784127813050", "4845168114407329"} <= set(found[0])
    assert "4111 1111 1111 1111" in found[1] and found[1].count("4465758382889437") == 2
    mails = ["joe (at) b (dot) org (at) d (dot) com"]
    assert {"joe (at) b (dot) org", "org (at) d (dot) com"} <= set(further(spark, mails, "email")[0])


def test_numbers_beside_others_are_added(spark):
    r = random.Random(13)
    number = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    texts = [f"so +1 ({number(3)}) {number(3)}-{number(4)} now, 4111111111111111 here" for _ in range(300)]
    texts += ["Des +1 (826) 555-4081 190.137.223.204 du", "a 4465758382889437 4465758382889437 b"]
    rows = {x["doc_id"]: x for x in pii.find_spans(frame(spark, list(enumerate(texts)))).collect()}
    phones = rows[300]["added_phone"]
    assert "+1 (826) 555-4081" in [x["found"] for x in phones]
    assert all(a["stop"] <= b["start"] for a, b in zip(phones, phones[1:]))
    assert [x["found"] for x in rows[300]["base_ip"]] == ["190.137.223.204"]
    assert [x["found"] for x in rows[301]["added_card"]] == ["4465758382889437"] * 2


def test_rows_of_the_given_documents(spark):
    for folder, kind, named in (
        ("sf0.1", "phone", {1377: "+1 (826) 555-4081", 7052: "+1 (843) 555-7672"}),
        ("sf0.1", "card", {46: "4845168114407329", 1262: "4550997810720808"}),
        ("sf0.01", "card", {254: "4465758382889437", 402: "4465758382889437"}),
    ):
        docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").filter(f"doc_id in {tuple(named)}")
        rows = pii.candidates(docs, "doc_id", "text").collect()
        assert len(rows) == 2 and all(named[r["doc_id"]] in {x["found"] for x in r[f"more_{kind}"]} for r in rows)


def test_empty_table(spark):
    assert pii.find_spans(frame(spark, [])).count() == 0


def test_spellings_that_no_strict_pattern_knows_are_added(spark):
    r = random.Random(15)
    number = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))

    def card():
        digits = "4" + number(14)
        return next(digits + d for d in "0123456789" if valid("card", digits + d))

    texts, added = [], {}
    for _ in range(400):
        texts.append(f"{name()} write to {name()}@{name()}.org about {name()}")
        texts.append(f"{name()} call +1 ({number(3)}) 555-{number(4)} or {name()}")
        texts.append(f"{name()} paid with {card()} on {name()} {number(4)}-{number(2)}")
        texts.append(f"{name()} row {number(3)} {number(4)} {number(5)} {number(4)} end {name()}")
    for _ in range(50):
        spelt = f"{name()} (at) {name()} (dot) org"
        added[len(texts)] = ("email", spelt)
        texts.append(f"{name()} write to {spelt} about {name()}")
        spelt = f"({number(3)}) 555-{number(4)}"
        added[len(texts)] = ("phone", spelt)
        texts.append(f"{name()} call {spelt} or {name()}")
        plain = card()
        spelt = "/".join(plain[i : i + 4] for i in range(0, 16, 4))
        added[len(texts)] = ("card", spelt)
        texts.append(f"{name()} paid with {spelt} on {name()}")
    clean = range(len(texts), len(texts) + 60)
    texts += [f"{name()} {name()} version {r.randrange(9)}.{r.randrange(9)} of {r.randrange(1990, 2030)}, page {number(3)}" for _ in clean]
    rows = {x["doc_id"]: x for x in pii.find_spans(frame(spark, list(enumerate(texts)))).collect()}
    for kind in ("email", "phone", "card"):
        own = [i for i, (k, _) in added.items() if k == kind]
        hit = [added[i][1] in [y["found"] for y in rows[i][f"added_{kind}"]] for i in own]
        assert sum(hit) >= 0.9 * len(own), (kind, sum(hit))
    assert not any(rows[i][f"added_{kind}"] for i in clean for kind in pii.KINDS)


def test_a_few_cards_among_numbers_are_added_at_any_size(spark):
    """Numbers that fail Luhn stand for one in nine that passes it by chance."""
    r = random.Random(19)
    number = lambda n: "".join(str(r.randrange(10)) for _ in range(n))

    def card():
        digits = "4" + number(14)
        return next(digits + d for d in "0123456789" if valid("card", digits + d))

    for size in (40, 400):
        texts = [f"so {card()} here" for _ in range(size)]
        texts += [f"so {x} here" for x in (number(16) for _ in range(size // 2)) if not valid("card", x)]
        pair = [card(), card()]
        texts.append(f"a {pair[0]} {pair[1]} b")
        rows = {x["doc_id"]: x for x in pii.find_spans(frame(spark, list(enumerate(texts)))).collect()}
        assert [x["found"] for x in rows[len(texts) - 1]["added_card"]] == pair


def test_failed_candidates_count_once_where_they_overlap(spark):
    from pyspark.sql import functions as F

    spans = [(0, 5), (0, 9), (3, 7), (9, 12), (20, 21)]
    rows = spark.createDataFrame([([(a, b, "x", "", "") for a, b in spans],)], f"z {pii.SPANS}")
    found = rows.select(pii._apart(F.col("z")).alias("z")).first()["z"]
    assert (found[0]["start"], found[0]["stop"]) == (0, 9) and (found[-1]["start"], found[-1]["stop"]) == (20, 21)
    assert [(x["start"], x["stop"]) for x in found].count((0, 5)) == 0
