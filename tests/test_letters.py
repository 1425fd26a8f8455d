import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators import guidelines, letters, report, similarity
from caseflow.operators import vectors as index_of_vectors
from caseflow.profiles import RESPIRATORY_FAILURE, SEPSIS
from tests import models


@pytest.mark.parametrize("header_lines", [None, 15])
def test_denial_start_equals_the_model(spark, header_lines):
    rnd = random.Random(4)
    words = ["Aetna letter", "UHC", "re: claim 7", "plain", "Medicare and Cigna", "clinical review"]
    docs = {}
    for d in range(40):
        docs[d] = [
            "\n".join(rnd.choice(["x"] * 6 + words) for _ in range(rnd.choice([3, 20])))
            for _ in range(rnd.randint(1, 5))
        ]
    rows = [(d, i + 1, p) for d, pages in docs.items() for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "doc_id long, page_no int, page_text string")
    starts = letters.denial_start(frame, header_lines=header_lines)
    got = {r.doc_id: (r.denial_start_page, r.payor) for r in starts.collect()}
    assert got == {
        d: models.denial_start(p, letters.PAYORS, letters.SUBJECT_PHRASES, header_lines) for d, p in docs.items()
    }
    texts = {(r.doc_id, r.section): r.text for r in letters.letter_sections(frame, starts).collect()}
    for d, pages in docs.items():
        first = got[d][0] - 1
        assert texts[d, "rebuttal"] == "\n\n".join(pages[:first])
        assert texts.get((d, "denial"), "") == "\n\n".join(pages[first:])


def test_pages_of(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc"), (2, "")], "doc_id long, text string")
    rows = letters.pages_of(frame, 2).orderBy("doc_id", "page_no").collect()
    assert [(r.doc_id, r.page_no, r.page_text) for r in rows] == [(1, 1, "a\nb"), (1, 2, "c"), (2, 1, "")]


def test_denial_fields(spark):
    replies = [
        "ACCOUNT_ID: H12345678\nPAYOR: A: B\nORIGINAL_DRG: 871\nPROPOSED_DRG: none\nIS_SEPSIS: Yes",
        "no colon\nPAYOR:\naccount_id: NONE\nPAYOR: Last\nIS_SEPSIS: no", "",
    ]
    frame = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    out = letters.denial_fields(frame, SEPSIS).orderBy("i").collect()
    assert [tuple(r)[1:] for r in out] == [
        ("123456", "A: B", "871", None, True), (None, "Last", None, None, False),
        (None, "Unknown", None, None, False),
    ]


def test_duplicates_form_no_pairs(spark):
    base = "word " * 120
    texts = [base + "one", base.upper() + "  two", "word " * 60 + "other " * 90, "word " * 60 + "third " * 90, "unique", "unique2"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in letters.duplicate_letters(letters.fingerprints(frame)).collect()}
    assert {d: (r.n_exact, r.n_partial, r.match_type) for d, r in out.items()} == {
        0: (0, 3, "PARTIAL"), 1: (0, 3, "PARTIAL"), 2: (0, 3, "PARTIAL"), 3: (0, 3, "PARTIAL"),
    }
    copies = spark.createDataFrame([(i, base) for i in range(300)], "doc_id long, text string")
    rows = letters.duplicate_letters(letters.fingerprints(copies)).collect()
    assert len(rows) == 300 and {r.n_exact for r in rows} == {299}
    members = letters.group_members(letters.fingerprints(copies)).collect()
    assert {(r.group_id, r.group_size) for r in members} == {(0, 300)} and len(members) == 300


def test_pages_and_replies_cost_their_length(spark):
    import time

    from caseflow.functions.text import key_values

    def seconds(frame):
        frame.write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def pages(n):
        return letters.pages_of(spark.createDataFrame([(1, "line\n" * n)], "doc_id long, text string"), 10)

    def reply(n):
        text = "\n".join(f"K{i}: v" for i in range(n))
        return spark.createDataFrame([(text,)], "r string").select(F.size(key_values(F.col("r"))))

    for build, n in ((pages, 100_000), (reply, 20_000)):
        assert seconds(build(2 * n)) < 3.2 * seconds(build(n)) + 0.5


def test_a_later_none_takes_nothing_back(spark):
    frame = spark.createDataFrame([("ORIGINAL_DRG: 871\noriginal_drg: NONE\nORIGINAL_DRG:\nPAYOR: a\nPAYOR: b",)], "reply string")
    row = letters.denial_fields(frame, SEPSIS).first()
    assert (row.original_drg, row.payor) == ("871", "b")


def test_letter_text_takes_both_forms_of_evidence(spark):
    import json

    from caseflow.operators import report

    body = {"salutation": "Dear", "rationale": {"organ_dysfunction": ["in words", {"criterion": "c", "value": 3, "threshold": "t"}]}}
    frame = spark.createDataFrame([(json.dumps(body),), (json.dumps({"letter": body}),)], "reply string")
    texts = [r[0] for r in frame.select(report.letter_text(F.col("reply"))).collect()]
    assert texts[0] == texts[1] and "  - in words\n  - c: 3 (threshold: t)" in texts[0] and "Dear" in texts[0]


def test_definitions_keep_their_summary(spark):
    frame = spark.createDataFrame(
        [("A_x.pdf", "short", "sum"), ("b.pdf", "text", ""), ("c.pdf", "text", None)],
        "source_file string, definition_text string, definition_summary string",
    )
    out = letters.definition_library(frame, F.current_timestamp()).orderBy("source_file").collect()
    assert [r.definition_summary for r in out] == ["sum", "text", "text"]


@pytest.mark.parametrize(
    "kind,pages,lines,chars,hand,expected",
    [("docx", 0, 0, 0, 0, 0.0), ("pdf", 0, 0, 0, 0, 1.0), ("pdf", 1, 4, 49, 0, 0.8), ("pdf", 1, 4, 49, 10, 1.0),
     ("pdf", 2, 19, 199, 0, 0.58), ("pdf", 1, 19, 150, 5, 0.39), ("pdf", 1, 20, 200, 0, 0.0)],
)
def test_scan_confidence(spark, kind, pages, lines, chars, hand, expected):
    c = letters.scan_confidence(F.lit(kind), F.lit(pages), F.lit(lines), F.lit(chars), F.lit(hand), F.lit(10))
    assert spark.range(1).select(c.alias("x")).first().x == pytest.approx(expected)


def test_condition_type(spark):
    rows = [(True, "", "", []), (False, "193", "872", []), (False, "281", "", []), (None, "", "", ["none", "pneumonia, sepsis"]),
            (None, "", "", ["admission"]), (None, "", "", ["heart"]), (None, None, None, None)]
    frame = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "i int, s boolean, o string, p string, r array<string>"
    )
    def kinds(whole):
        c = letters.condition_type(F.col("s"), F.col("o"), F.col("p"), F.col("r"), whole)
        return [r.x for r in frame.select("i", c.alias("x")).orderBy("i").collect()]
    assert kinds(False) == ["sepsis", "sepsis", "cardiac", "sepsis", "cardiac", "cardiac", "default"]
    assert kinds(True)[4] == "default"


def test_criteria_hit(spark):
    rows = [("sepsis", "labs", "Lactate, venous"), ("sepsis", "vitals", "Lactate"), ("odd", "labs", "wbc count"), ("cardiac", "meds", None)]
    frame = spark.createDataFrame(rows, "c string, t string, n string")
    got = [r.x for r in frame.select(letters.criteria_hit(F.col("c"), F.col("t"), F.col("n")).alias("x")).collect()]
    assert got == [True, False, True, False]


def vectors(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_letters_alike_by_place_are_brute_force_s(spark):
    r = random.Random(21)
    bases = ["".join(r.choice("abcdé ") for _ in range(n)).strip() or "x" for n in (3, 37, 120, 260, 260)]
    rows = [(0, None), (1, ""), (2, "  ")]
    for i in range(3, 160):
        text = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 3, 6, 12])):
            text[r.randrange(len(text))] = r.choice("abcdé")
        rows.append((i, "".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    opened = {i: " ".join((t or "").split()).lower()[:200] for i, t in rows}
    want = {}
    for i, a in opened.items():
        same = [j for j, b in opened.items() if b == a]
        near = [j for j, b in opened.items() if b != a and len(b) == len(a) and 100 * sum(x == y for x, y in zip(a, b, strict=True)) >= 95 * len(a)]
        if a and len(same) + len(near) > 1:
            want[i] = (len(same) - 1, len(near), min(same + near))
    found = {x.doc_id: (x.n_same, x.n_similar, x.first_doc_id) for x in letters.similar_letters(frame).collect()}
    assert found == want and any(n for _, n, _ in want.values())


def cosines(q, s, k, exclude_same=False):
    """The best ``k`` of all pairs; vectors without direction score 0."""

    def cos(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / na / nb, 9) + 0.0 if na and nb else 0.0

    out = {}
    for i, v in q:
        if v is not None:
            scored = [(i2, cos(v, w)) for i2, w in s if w is not None and not (exclude_same and i2 == i)]
            out[i] = sorted(scored, key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("exclude_same", [False, True])
@pytest.mark.parametrize(("block_rows", "cells"), [(1000, None), (3, 1), (3, 4), (22, None), (2, 23)])
def test_top_matches_equal_brute_force(spark, block_rows, cells, exclude_same):
    rnd = random.Random(7)
    def draw():
        return [float(rnd.randint(-2, 2)) for _ in range(4)]
    q = [(i, draw()) for i in range(17)] + [(90, [0.0] * 4), (91, None)]
    s = [(i, draw()) for i in range(23)] + [(80, None), (85, [0.0] * 4), (86, [0.0] * 4)]
    out = similarity.top_matches(
        vectors(spark, q, "query_id"), vectors(spark, s, "letter_id"), 4, exclude_same, block_rows=block_rows, cells=cells
    )
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.letter_id, round(r.score, 9) + 0.0)
    assert {i: [x[n] for n in sorted(x)] for i, x in got.items()} == cosines(q, s, 4, exclude_same)


def test_the_index_leaves_cells_out(spark):
    """Letters in well-parted groups: a query is sent to few cells, and the result is exact."""
    rnd = random.Random(3)
    middles = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(16)]
    near = lambda: [round(1024 * (x + rnd.gauss(0, 0.05))) / 1024 for x in rnd.choice(middles)]
    sent = {}
    for n in (150, 300, 600):
        s, q = [(i, near()) for i in range(n)], [(i, near()) for i in range(n // 3)]
        letters, queries = vectors(spark, s, "letter_id"), vectors(spark, q, "query_id")
        found = similarity.indexed_matches(queries, letters, n, 5, block_rows=50, cells=16)
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, {})[r.rank] = r.letter_id
        assert {i: [x[k] for k in sorted(x)] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in cosines(q, s, 5).items()}
        index = index_of_vectors.build(letters, n, cells=16)
        least = found.filter("rank = 5").selectExpr("query_id", "score _least")
        sent[n] = sum(index_of_vectors.visits(queries.join(least, "query_id"), index, 5, later).count() for later in (False, True))
        assert sent[n] < 4 * len(q)
    assert sent[600] < 2.5 * sent[300]


@pytest.mark.parametrize("looks", [2, 1000])
def test_a_query_the_bounds_spare_little_is_sent_to_few_cells(spark, monkeypatch, looks):
    """Letters in no groups: a query has at most ``looks`` rows, and the result is exact either way."""
    rnd = random.Random(8)
    rows = [(i, [round(1024 * rnd.gauss(0, 1)) / 1024 for _ in range(12)]) for i in range(150)] + [(200 + i, [1.0] + [0.5] * 11) for i in range(20)]
    letters, queries = vectors(spark, rows, "letter_id"), vectors(spark, rows, "query_id")
    met, sent = similarity._met, []
    monkeypatch.setattr(similarity, "_met", lambda v, *a: sent.append(v.groupBy("query_id").count().agg({"count": "max"}).first()[0]) or met(v, *a))
    got = {}
    for r in similarity.indexed_matches(queries, letters, len(rows), 4, True, block_rows=50, looks=looks, cells=40).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.letter_id, round(r.score, 9) + 0.0)
    assert {i: [x[n] for n in sorted(x)] for i, x in got.items()} == cosines(rows, rows, 4, True)
    assert (max(n or 0 for n in sent[1:]) <= 2) == (looks == 2)


def test_best_match_defaults(spark):
    q = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0])], "query_id")
    s = vectors(spark, [(7, [1.0, 0.1]), (8, [1.0, 1.0])], "letter_id")
    out = {r.query_id: (r.letter_id, round(r.score, 3), r.is_default) for r in similarity.best_match(q, s, 0.8, 99).collect()}
    assert out == {1: (7, 0.995, False), 2: (99, 0.0, True), 3: (99, 0.0, True), 4: (99, 0.0, True), 5: (99, 0.0, True)}
    why = {r.query_id: r.fallback_reason for r in similarity.matches_with_reason(q, s, 1, 0.8).collect()}
    assert why[1] is None and why[2] == "Best match score (0.71) below threshold (0.8)"
    assert why[4] == "No gold letters have embeddings"


def test_retrieval(spark):
    criteria = spark.createDataFrame([(i, ["common"] + (["rare"] if i == 9 else [])) for i in range(10)], "criteria_id long, relevance array<string>")
    requests = spark.createDataFrame([(1, ["rare", "common"]), (2, ["none"]), (3, []), (4, None), (5, ["rare"])], "request_id long, signals array<string>")
    out = {}
    for r in similarity.retrieve_criteria(requests, criteria, 3).collect():
        out.setdefault(r.request_id, []).append(r.criteria_id)
    assert {k: sorted(v) for k, v in out.items()} == {1: [0, 1, 2], 3: [0, 1, 2], 4: [0, 1, 2], 5: [9]}


def test_guidelines(spark):
    docs = spark.createDataFrame(
        [("Heart failure acute", "A1, B2"), ("Acute lung injury", "C3,P9"), ("Lung failure", "NAME"), ("Zeta lung failure", "Q")],
        "file_name string, codes string",
    )
    dx = spark.createDataFrame(
        [(1, "B2", "kidney", None, None), (2, "X", "acute heart failure", "P9", None), (3, "X", "lung edema", None, None),
         (4, "X", "lung failure", None, "NAME"), (5, "X", "nothing", None, "NAME"), (6, None, None, None, None), (7, "X", "the of", None, None)],
        "account_id long, dx_code string, dx_name string, proc_code string, px_name string",
    )
    out = {r.account_id: r for r in guidelines.best_guidelines(dx, docs).collect()}
    assert len(out) == 7
    assert {a: (r.file_name, r.combined) for a, r in out.items()} == {
        1: ("Heart failure acute", 1.0), 2: ("Acute lung injury", 0.8), 3: ("Acute lung injury", pytest.approx(0.1)),
        4: ("Lung failure", 0.6), 5: (None, None), 6: (None, None), 7: (None, None),
    }


def guideline_tables(random_, hot):
    """Names and documents over few words; with ``hot`` one word is in all of them, and one code too."""
    words = [f"word{i}" for i in range(9)]
    head = "common " if hot else ""
    docs = [
        (head + " ".join(random_.choices(words, k=random_.randrange(5))) + f" file{i}", ",".join(random_.choices(["A", "B", "C", "D"], k=2)) + (",H" if hot else ""))
        for i in range(60)
    ]
    docs += [(None, "A"), ("word1 word2", None), ("word2 word1", "E")]
    codes = ["A", "B", "C", "Z", None] + (["H"] * 3 if hot else [])
    dx = [
        (i, random_.choice(codes), head + " ".join(random_.choices([*words, "other"], k=random_.randrange(6))), random_.choice(codes), random_.choice(codes))
        for i in range(150)
    ]
    return docs, [*dx, (900, None, None, None, None), (901, "A", None, "B", "C"), dx[0]]


def best_guideline(row, docs):
    _, dx_code, dx_name, proc_code, px_name = row

    def words(text):
        return {w for w in (text or "").split() if w not in ("other",)}

    own, found = words(dx_name), []
    for name, codes in docs:
        shared, n = len(own & words(name)), len(words(name))
        similarity = shared / len(own) if own else 0.0
        for code in {c.strip() for c in codes.split(",")} if codes is not None else set():
            worth = [w for w, c in ((1.0, dx_code), (0.8, proc_code)) if c == code] + ([0.6] if px_name == code and shared else [])
            found += [(-w, -similarity, -n, name or "", code) for w in worth]
        if shared:
            found.append((-0.2 * similarity, -similarity, -n, name or "", ""))
    return min(found)[:4] if found else None


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("common", [1, 3, 256])
def test_guidelines_are_brute_force_s(spark, hot, common):
    docs, dx = guideline_tables(random.Random(5), hot)
    documents = spark.createDataFrame(docs, "file_name string, codes string")
    diagnoses = spark.createDataFrame(dx, "account_id long, dx_code string, dx_name string, proc_code string, px_name string")
    found = guidelines.best_guidelines(diagnoses, documents, common).collect()
    assert len(found) == len(dx)
    by_account = {r[0]: r for r in dx}
    for r in found:
        want = best_guideline(by_account[r.account_id], docs)
        got = None if r.combined is None else (-r.combined, -r.similarity, -r.n_tokens, r.file_name or "")
        assert (got is None) == (want is None)
        if want is not None:
            assert got[:3] == pytest.approx(want[:3], abs=1e-12) and got[3] == want[3]


def test_a_word_of_all_names_and_documents_costs_a_row_each(spark, monkeypatch):
    """What meets under an item is at most ``common`` times what is listed under it."""
    n, met = 400, []
    asked = spark.createDataFrame([("", f"n{i}", sorted(["hot", f"a{i}"]), True) for i in range(n)], "group string, name string, words array<string>, needs_word boolean")
    documents = spark.createDataFrame([("", f"d{i:03}", sorted(["hot", f"b{i}"])) for i in range(n)], "group string, file_name string, words array<string>")
    ranked = guidelines.top_per
    monkeypatch.setattr(guidelines, "top_per", lambda rows, *a: met.append(rows.count()) or ranked(rows, *a))
    found = guidelines.best_sharing(asked, documents, common=8).collect()
    assert met == [n]
    assert {(r.file_name, r.n_shared) for r in found} == {("d000", 1)} and len(found) == n


def test_assessment(spark):
    frame = spark.createDataFrame(
        [(1, '```json\n{"overall_score": 14.6, "criteria": {"score": 3, "findings": [{"status": "missing", "item": "i"}]}}\n```'),
         (2, "not json"), (3, '{"overall_score": 0, "summary": "s"}')],
        "account_id long, reply string",
    )
    parsed = report.parsed_assessment(frame)
    assert [r.overall_score for r in parsed.orderBy("account_id").collect()] == [10, None, 1]
    rows = report.assessment_rows(parsed).collect()
    assert [(r.account_id, r.dimension, r.score, r.mark, r.item) for r in rows] == [(1, "CRITERIA", "3", "✗", "i")]


def test_letter_text_optional_sections(spark):
    one = spark.range(1)
    text = one.select(report.letter_text(F.lit("{}")).alias("x")).first().x
    assert "First Level Appeal" in text and "Infection Source" not in text and text.endswith("Sincerely,\n\n")
    body = '{"rationale": {"sirs_criteria": [{"criterion": "HR", "value": "120", "threshold": "90"}], "other_conditions": []}}'
    text = one.select(report.letter_text(F.lit(body)).alias("x")).first().x
    assert "SIRS Criteria Met:\n  - HR: 120 (threshold: 90)\n\nHospital Course:" in text


def test_rebuttals_and_status(spark):
    rows = spark.createDataFrame([(1, "b", "two"), (1, "a", "one"), (2, "c", "x")], "account_id long, name string, text string")
    sections = {r.account_id: r.rebuttals_section for r in report.rebuttal_sections(rows).collect() if r.part_no == 0}
    assert sections == {1: "## a\none\n\n## b\ntwo", 2: "## c\nx"}
    frame = spark.createDataFrame(
        [(1, "bad", True, "gen"), (2, None, False, "gen"), (3, None, True, "gen"), (4, None, True, None), (5, None, None, None)],
        "i int, p string, s boolean, g string",
    )
    status, reason = report.case_status(F.col("p"), report.in_scope(F.col("s"), "sepsis"), F.col("g"))
    out = frame.select("i", status.alias("status"), reason.alias("why")).orderBy("i").collect()
    assert [r.status for r in out] == ["parse_error", "out_of_scope", "generation_error", "success", "out_of_scope"]
    assert frame.select(report.in_scope(F.col("s"), "all").alias("x")).distinct().first().x is True
    assert {r.status: r.n_cases for r in report.status_tally(frame.select(status.alias("status"))).collect()}["out_of_scope"] == 2


def test_letter_text_parses_a_letter_once(spark):
    """The plan names the parse of the letter and of an evidence item once each, not once a field."""
    frame = spark.range(1).select(report.letter_text(F.col("id").cast("string")).alias("x"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 1 + 3 and plan.count("get_json_object(") == 1
