import pytest
from pyspark.sql import functions as F

from caseflow.functions import text, times, values
from caseflow.functions.values import Band, Matcher
from caseflow.profiles import SEPSIS, SOFA_BANDS, VASOPRESSORS


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def each(spark, inputs, build, kind="string"):
    rows = [(i, x) for i, x in enumerate(inputs)]
    frame = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r.y for r in frame.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_safe_double(spark):
    inputs = ["<5", ">1,200", " 7\t\n", "", None, "abc", "nan", "inf", "1.0d", "1_0", "1e2", "-.5", "< 3"]
    got = each(spark, inputs, values.safe_double)
    assert got == [5.0, 1200.0, 7.0, None, None, None, None, None, None, None, 100.0, -0.5, 3.0]


def test_names_match_by_keyword_and_exclusion(spark):
    names = ["Bilirubin, Total", "Bilirubin Direct", "PCO2", "PO2 ART", "Platelet Antibody", None]
    got = each(spark, names, lambda c: F.array_compact(values.categories(c, SEPSIS.matchers, "lab")))
    assert got == [["bilirubin"], [], [], ["pao2"], [], []]


def test_whole_word_matching(spark):
    m = Matcher(("ph",))
    assert each(spark, ["Lymphocytes", "pH"], lambda c: values.matches(c, m)) == [True, True]
    assert each(spark, ["Lymphocytes", "pH"], lambda c: values.matches(c, m, True)) == [False, True]


def test_exclusive_categories(spark):
    both = {"pao2": Matcher(("o2",)), "fio2": Matcher(("fio2",))}
    plain = each(spark, ["FiO2"], lambda c: F.array_compact(values.categories(c, both)))
    once = each(
        spark, ["FiO2"],
        lambda c: F.array_compact(values.categories(c, both, exclusive=("pao2", "fio2"))),
    )
    assert plain == [["pao2", "fio2"]] and once == [["pao2"]]


def test_first_drug_decides(spark):
    names = ["Norepinephrine 4mg", "EPINEPHrine", "Levophed", "saline", None]
    got = each(spark, names, lambda c: values.first_category(c, VASOPRESSORS))
    assert got == ["norepinephrine", "epinephrine", "norepinephrine", None, None]


@pytest.mark.parametrize(
    "organ,inputs,scores",
    [
        ("respiratory", [400, 399.9, 300, 299.9, 200, 100, 99.9], [0, 1, 1, 2, 2, 3, 4]),
        ("coagulation", [150, 149, 100, 50, 20, 19.9], [0, 1, 1, 2, 3, 4]),
        ("liver", [1.19, 1.2, 2.0, 6, 12], [0, 1, 2, 3, 4]),
        ("cardiovascular", [70, 69.9], [0, 1]),
        ("cns", [15, 14, 13, 12, 10, 9, 6, 5, 16], [0, 1, 1, 2, 2, 3, 3, 4, 0]),
        ("renal", [1.1, 1.2, 2.0, 3.5, 5.0], [0, 1, 2, 3, 4]),
    ],
)
def test_bands(spark, organ, inputs, scores):
    got = each(spark, [float(x) for x in inputs], lambda c: values.band(c, SOFA_BANDS[organ]), "double")
    assert got == scores


def test_band_of_null_is_null(spark):
    assert each(spark, [None], lambda c: values.band(c, (Band(1, 0, 1),)), "double") == [None]


def test_berlin_and_fraction(spark):
    got = each(spark, [100.0, 100.1, 200.0, 300.0, 300.1, None], values.berlin, "double")
    assert got == ["Severe ARDS", "Moderate ARDS", "Moderate ARDS", "Mild ARDS", "Normal", None]
    assert each(spark, [0.4, 40.0, 1.0], values.oxygen_fraction, "double") == [0.4, 0.4, 1.0]


def test_rounding_equals_python(spark):
    inputs = [0.15, 0.25, 0.35, 30.75, 2.675, 1234567.25, -0.05, 99.95]
    assert each(spark, inputs, lambda c: values.exact_round(c, 1), "double") == [
        round(x, 1) for x in inputs
    ]
    assert each(spark, inputs, lambda c: values.fixed(c, 2), "double") == [f"{x:.2f}" for x in inputs]


def test_account_numbers(spark):
    inputs = ["H1234567", "h12x9", "H12", "1234", None, " H99901 ", "H12a45"]
    assert each(spark, inputs, values.account_number) == ["12345", "12", None, None, None, "999", None][:7]


def test_relative_gap(spark):
    r = one(
        spark,
        values.relative_gap(F.lit(1.1), F.lit(1.0)),
        values.relative_gap(F.lit(0.3), F.lit(0.0)),
        values.relative_gap(F.lit(-1.0), F.lit(-2.0)),
    )
    assert r.c0 == pytest.approx(0.1) and r.c1 == 0.3 and r.c2 == 0.5


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(y)).cast("float") for y in x])
    r = one(spark, values.cosine(v(1, 0), v(1, 1)), values.cosine(v(0, 0), v(1, 1)))
    assert r.c0 == pytest.approx(0.70710678) and r.c1 == 0.0


def test_ratings(spark):
    assert each(spark, [1, 4, 5, 7, 8, None], values.rating, "int") == [
        "LOW", "LOW", "MODERATE", "MODERATE", "HIGH", None,
    ]
    assert each(spark, [-3.0, 5.9, 99.0], lambda c: values.clamp(c, 1, 10), "double") == [1, 5, 10]


def test_tokens(spark):
    got = each(spark, ["The Heart-failure of other, acute acute failure", None], text.tokens)
    assert got == [["heartfailure", "acute", "failure"], None]


def test_key_values(spark):
    inputs = ["A: 1\nb:2:3\nA: 4\nnope\nc:", "nothing", "A: YES\r\n\tB : x\t\r\n"]
    got = each(spark, inputs, text.key_values)
    assert got == [{"B": "2:3", "A": "4", "C": ""}, {}, {"A": "YES", "B": "x"}]


def test_fences(spark):
    inputs = ['x ```json\n{"a":1}\n``` y', "plain ", "```\n[1]\n```", "say ```x``` now"]
    assert each(spark, inputs, text.without_fence) == ['{"a":1}', "plain", "[1]", "x"]
    assert each(spark, inputs, text.without_leading_fence)[3] == "say ```x``` now"


def test_fill_keeps_braces_in_values(spark):
    r = one(
        spark,
        text.filled(F.lit("{a} {b} {a} {zz}"), {"a": F.lit("{b}"), "b": F.lit(None).cast("string")}),
    )
    assert r.c0 == "{b}  {b} {zz}"


def test_names_and_titles(spark):
    assert each(spark, ["discharge_summary"], text.title_of) == ["Discharge Summary"]
    assert each(spark, ["O'Neil, Zoé (x)-1_2 "], text.safe_file_name) == ["ONeil Zoé x-1_2"]
    assert each(spark, ["Kb_Sepsis.V2.PDF", "other.pdf"], lambda c: text.condition_of_file(c, "kb_")) == [
        "sepsis.v2", "other",
    ]


def test_bold_runs_and_paragraphs(spark):
    got = each(spark, ["pre **b** mid **c**", "none", "**x**", "a ** b"], text.bold_runs)
    assert [[(r.text, r.bold) for r in x] for x in got] == [
        [("pre ", False), ("b", True), (" mid ", False), ("c", True)],
        [("none", False)], [("x", True)], [("a ** b", False)],
    ]
    assert each(spark, ["a\n\n \n\nb\n\n\n"], text.paragraphs) == [["a", "b"]]


def test_shortened_and_overlap(spark):
    assert each(spark, ["abcdef", "ab"], lambda c: text.shortened(c, 3, "...")) == ["abc...", "ab"]
    r = one(
        spark,
        text.character_overlap(F.lit("abc d"), F.lit("abx  d e")),
        text.character_overlap(F.lit("abc"), F.lit("xx ABC yy")),
        text.character_overlap(F.lit(""), F.lit("a")),
    )
    assert (r.c0, r.c1, r.c2) == (0.8, 1.0, 0.0)


def test_claim_times(spark):
    inputs = ["1/5/2024 9:07", "01/05/2024", "2024-01-05 09:07", "2024-01-05", "unknown", None]
    got = each(spark, inputs, lambda c: F.date_format(times.parsed(c), "yyyy-MM-dd HH:mm"))
    assert got == ["2024-01-05 09:07", "2024-01-05 00:00", "2024-01-05 09:07", "2024-01-05 00:00", None, None]


def test_encounter_times(spark):
    ts = lambda s: F.to_timestamp(F.lit(s))
    r = one(
        spark,
        times.midnights(ts("2024-01-01 23:59:00"), ts("2024-01-03 00:01:00")),
        times.age(ts("1980-06-15"), ts("2024-06-14")),
        times.timing(ts("2024-01-05"), ts("2024-01-01"), F.lit(None).cast("timestamp")),
        times.timing(ts("2024-01-05"), ts("2024-01-01"), ts("2024-01-04")),
        times.recorded(F.lit("2024-01-05 10:11:12.345")),
    )
    assert (r.c0, r.c1, r.c2, r.c3) == (2, 43, "DURING", "AFTER") and r.c4.second == 12


def test_no_value_ends_a_job(spark):
    numbers = ["1e999", "-1e999", "1e308", "<1e-320", "99999999999", "1e30"]
    got = each(spark, numbers, values.safe_double)
    assert got[:3] == [None, None, 1e308] and got[4:] == [99999999999.0, 1e30]
    frame = spark.createDataFrame([(1e300,), (float("inf"),), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in frame.select(values.exact_round(F.col("x"), 1)).collect()][1::2] == [None, None]
    assert [r[0] for r in frame.limit(2).select(values.clamp(F.col("x"), 1, 10)).collect()] == [10, 10]


def test_number_text_is_python_s(spark):
    numbers = [0.0, 0.0004, 0.01 / 60, 1e-4, 9.9e-5, 1.25e-7, 0.001, 12.5, 1234567.25, 1e7, 12345678.9, 1e15, 1e16, 1.5e22, 2.5e120, -0.00025, -3e-9]
    assert each(spark, numbers, values.number_text, "double") == [repr(x) for x in numbers]
    assert one(spark, values.number_text(F.lit(None).cast("double"))).c0 is None
