"""Literal vectors of the scalar rules."""

from pyspark.sql import functions as F

from syllaweave.functions import course as C
from syllaweave.functions.special import digamma, trigamma
from syllaweave.operators.prerequisites import alias_met


def values(spark, f, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_programmes(spark):
    cases = {
        "I T": "IT", "COMPUTER": "COMP", "CSE Data Science (311)": "CSE-DS", "DATA SCIENCES": "DS", "MECHATORNICS": "MECHATRONICS", "ARTIFICAL INTELLIGENCE": "AI",
        "Computer Science & Business Systems": "CSBS", "COMMON FOR ALL BRANCH": "COMMON", "Open Elective-I": "OPEN", "CSE CYBERSECURITY": "CSE-CYBER", "ELETRICAL": "ELECTRICAL", "x": "OTHER",
    }
    assert values(spark, C.programme_of, list(cases)) == list(cases.values())


def test_semesters_years_codes(spark):
    assert values(spark, C.sem_min, ["V/ VI", "I / II", "VII", "", None, "sem 10"]) == [5, 1, 7, None, None, 10]
    assert values(spark, C.year_key, ["2024-25", "AY 2024/25", "24–25", "2024-2025", "2024-26", "", None]) == ["2024-25"] * 4 + [None] * 3
    assert values(spark, C.code_key, ["bt.it 12", "Nil", "", None]) == ["BTIT12", None, None, None]
    assert values(spark, C.year_in_text, ["of 2023-24 and 2020-21", "2023-25"]) == ["2023-24", None]


def test_names(spark):
    assert values(spark, C.clean_name, ["Deep Learning (Department Elective III)", "Professional Elective Course - II (Ground Improvement)", "X  course code: AB1"]) == ["Deep Learning", "Ground Improvement", "X"]
    assert values(spark, C.line_key, [" Page 12  of 30 "]) == ["page # of #"]
    assert values(spark, C.slug, ["A b/C "]) == ["a-b-c"]


def test_outcome_verbs(spark):
    xs = ["Design a schema", "Explain the layers", "Apply it", "Students will be able to apply it", "", None]
    assert values(spark, C.lexicon_level, xs) == [6, 2, 3, None, None, None]
    assert values(spark, C.first_word, ["Students will be able to effectively design it", ""]) == ["design", None]


def test_prerequisites(spark):
    xs = ["Physics (BTME01003), Calculus and Linear Algebra", "NIL", "- NA", "Basic knowledge of Computer Networks", None]
    assert values(spark, C.split_prerequisites, xs) == [["Physics", "Calculus", "Linear Algebra"], [], [], ["Computer Networks"], []]
    xs = ["Engineering Mathematics - I, II and III", "Information Storage and Management", None, "Data Structures and Computer Networks (Semester- II), BTCS01003", "II and III", "Basics of Physics; NIL"]
    assert values(spark, C.split_prerequisites_v2, xs) == [
        ["Engineering Mathematics - I", "Engineering Mathematics - II", "Engineering Mathematics - III"], ["Information Storage and Management"], [],
        ["Data Structures", "Computer Networks"], ["II and III"], ["Physics"],
    ]


def test_alias(spark):
    df = spark.createDataFrame([("algorithm design", "Design of Algorithms"), ("mathematics", "Calculus"), ("physics", "Calculus"), ("", "Calculus")], "p string, n string")
    assert [r[0] for r in df.select(alias_met(F.col("p"), F.col("n"))).collect()] == [True, True, False, False]


def test_requirements_and_windows(spark):
    jd = "Role: Engineer\nResponsibilities:\n- Build data pipelines for many teams; keep all of them running well.\n- Short one\n"
    assert values(spark, C.requirements, [jd, None]) == [["Build data pipelines for many teams;", "keep all of them running well."], []]
    w = values(spark, lambda c: C.passages(c, 4, 1), ["a b c d e f g", "a b", "", None])
    assert w == [["a b c d", "d e f g"], ["a b"], [], []]
    assert values(spark, C.unit_topics, ["Loops: for, while; do-while (C) - x", None]) == [["Loops", "while", "do-while"], []]


def test_special(spark):
    r = spark.range(1).select(digamma(F.lit(1.0)), digamma(F.lit(0.5)), trigamma(F.lit(1.0))).first()
    assert abs(r[0] + 0.5772156649015329) < 1e-8
    assert abs(r[1] + 1.9635100260214235) < 1e-8
    assert abs(r[2] - 1.6449340668482264) < 1e-8
