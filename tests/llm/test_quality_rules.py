import random
import re

import pytest

from caseflow.llm import quality_rules
from tests.llm.frames import AWKWARD, frame


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    repeated = len(again)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        repeated,
        len(words) < 50 or 100 * repeated > 50 * len(words),
    )


def texts():
    r = random.Random(9)
    yield from (t for _, t, *_ in AWKWARD)
    for n in (0, 1, 2, 3, 4, 50, 400):
        for letters in ("ab", "abcdefgh"):
            yield "".join(r.choice([*letters, " ", " ", "\n", "\t", "#", "|", "é"]) for _ in range(n * 3))
    yield "a b c " * 30
    yield ("the quick brown fox is on it and " + " ".join(f"w{i}" for i in range(200)))


def test_measures(spark):
    data = [(i, t) for i, t in enumerate(texts())]
    found = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, data)).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in data:
        assert tuple(found[i][n] for n in names) == brute(t), t


def test_verdicts(spark):
    prose = "the cat is on the mat and " + " ".join(f"word{i}" for i in range(100))
    data = [(1, prose), (2, prose.replace(" ", "# ")), (3, "x " * 60), (4, " ".join(f"zq{i}" for i in range(90))), (5, None)]
    found = {r["doc_id"]: (r["kept"], r["broken"]) for r in quality_rules.judge(frame(spark, data)).collect()}
    assert found[1] == (True, [])
    assert not found[2][0] and "symbols" in found[2][1]
    assert "repeated_words" in found[3][1] and "stop_words" in found[4][1] and "too_few_words" in found[5][1]


def test_own_table(spark):
    rule = quality_rules.Rule("long", "n_words", "one", high=3, per=1)
    found = quality_rules.judge(frame(spark, [(1, "a b"), (2, "a b c d")]), rules=(rule,), base_rules=())
    assert [r["kept"] for r in found.orderBy("doc_id").collect()] == [True, False]


def test_no_python_and_no_exchange(spark):
    plan = quality_rules.judge(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", [20_000])
def test_long_texts_cost_their_length(spark, n):
    import time

    took = []
    for size in (n, 2 * n):
        text = " ".join(f"w{i % 7919}" for i in range(size))
        docs = frame(spark, [(1, text)]).cache()
        docs.count()
        quality_rules.judge(docs).collect()
        start = time.perf_counter()
        quality_rules.judge(docs).collect()
        took.append(time.perf_counter() - start)
    assert took[1] < 3.5 * took[0] + 0.5


def test_empty_table(spark):
    assert quality_rules.judge(frame(spark, [])).count() == 0
