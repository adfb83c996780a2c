"""Report tables, retrieval, page rules, sources and models on small fixtures, with nulls, ties, repeated and missing rows."""

import io
import math
import random
import re
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from syllaweave.functions import course as C
from syllaweave.operators import assemble as A, lexical as L, models, overlap as O, parse as P, prerequisites as Q, reports as R, retrieval as T, vectors as V, webpages as W
from syllaweave.sources import files as S


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=8))
def test_exact_paired_test(spark, cases):
    df = spark.createDataFrame(cases, "b bigint, c bigint")
    got = [r[0] for r in df.select(R.binomial_two_sided(F.col("b"), F.col("c"))).collect()]
    for (b, c), p in zip(cases, got):
        n = b + c
        want = None if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
        assert (p is None) == (want is None) and (want is None or abs(p - want) < 1e-9)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a b", "a", "b c", "c", "a c d", ""]), max_size=4, unique=True), st.lists(st.sampled_from(["a b", "b", "c b", "d", "a d"]), max_size=4, unique=True)), min_size=1, max_size=6))
def test_greedy_matches(spark, rows):
    df = spark.createDataFrame(rows, "g array<string>, s array<string>")
    got = [r[0] for r in df.select(R.greedy_tp(F.col("g"), F.col("s"), 0.5)).collect()]
    words = lambda x: set(re.findall("[a-z0-9]+", x))
    for (g, s), n in zip(rows, got):
        cand = sorted(((round(len(words(x) & words(y)) / max(1, len(words(x) | words(y))), 9), x, y) for x in g for y in s), reverse=True)
        a, b = set(), set()
        for v, x, y in cand:
            if v >= 0.5 and x not in a and y not in b:
                a.add(x)
                b.add(y)
        assert n == len(a)


def test_ranks_quotas_and_years(spark):
    df = spark.createDataFrame([("g", "a", 3.0), ("g", "b", 3.0), ("g", "c", 1.0), ("h", "d", None)], "g string, k string, s double")
    r = {x.k: x for x in df.select("k", R.percentile_rank(["g"], "s", "k").alias("p"), R.rank_among(["g"], "s").alias("r"), R.tie_averaged_rank(["g"], "s").alias("t")).collect()}
    assert (r["c"].p, r["b"].p, r["d"].p) == (0.0, 1.0, 0.0) and (r["a"].r, r["c"].r) == (1, 3) and r["a"].t == 1.5
    assert {x.k for x in R.quotas(df, "g", "k", {"g": 2}).collect()} < {"a", "b", "c"} and R.quotas(df, "g", "k", {}).count() == 0
    assert R.first_relevant(df, "g", "s", "k", F.col("k") == "c", depth=2).filter("g = 'g'").first()["rank"] == 1_000_000
    snap = spark.createDataFrame([("P", "2024-25", f"f{i}") for i in range(3)] + [("P", "2025-26", "f1"), ("Q", "2023-24", "f9")], "programme string, ay string, family string")
    years = {x.programme: x.ay for x in R.default_year(snap, snap.select("programme", "ay").distinct(), 3).collect()}
    assert years == {"P": "2024-25", "Q": "2023-24"}


def test_labels_and_targets(spark):
    items = spark.createDataFrame([(1, "A & B"), (2, "a and b"), (3, None), (4, "x")], "id int, name string")
    known = spark.createDataFrame([("A and B!", "yes"), ("a&b", "no")], "name string, label string")
    got = {r.id: (r.label, r.reused) for r in R.reuse_labels(items, known, ["name"], "label", "?").collect()}
    assert got == {1: ("no", True), 2: ("no", True), 3: ("?", False), 4: ("?", False)}
    t = spark.createDataFrame([("a", ">=", 0.5), ("b", "<=", 0.1), ("c", ">=", 1.0)], "metric string, op string, target double")
    v = spark.createDataFrame([("a", 0.5), ("b", 0.2)], "metric string, value double")
    assert {r.metric: r.met for r in R.against_targets(v, t).collect()} == {"a": "yes", "b": "no", "c": "n/a"}
    m = R.multilabel(spark.createDataFrame([([1, 2], [1]), ([], []), ([3], [2])], "t array<int>, p array<int>"), "t", "p", 4).first()
    assert m.n == 3 and abs(m.micro_f1 - 2 / 5) < 1e-12 and abs(m.macro_f1 - 1 / 3) < 1e-12 and abs(m.sample_f1 - (2 / 3 + 1 + 0) / 3) < 1e-12 and abs(m.hamming - 3 / 12) < 1e-12
    k = R.weighted_kappa(spark.createDataFrame([(1, 1), (2, 2), (3, 3), (None, 1)], "a int, b int"), "a", "b", 2).first()
    assert k.n == 3 and k.kappa == 1.0 and R.weighted_kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b", 1).first().kappa is None
    x = spark.createDataFrame([("t", "train", 2), ("t", "test", 1), ("u", "test", 3)], "text string, split string, id int")
    assert {(r.text, r.split) for r in R.without_leaks(x, "text", "split", ["train", "test"], "id").collect()} == {("t", "train"), ("u", "test")}
    assert R.fairness(spark.createDataFrame([], "programme string, n bigint, accuracy double"), 5).first().lowest is None


def test_numbering(spark):
    rows = [(random.Random(1).random() if i % 5 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, i int").repartition(6)
    got = S.numbered(df, ["s", "i"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 501)) and [(r.s, r.i) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert S.numbered(df.limit(0), ["i"], "n").count() == 0


def test_nearest_and_best_against_loops(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 7)
    rng = np.random.default_rng(2)
    items = [(g, int(b), g * 1000 + i, rng.normal(size=3).tolist()) for g in (0, 1) for i, b in enumerate(rng.integers(0, 3, 40))]
    queries = [(g, 10 * g + i, rng.normal(size=3).tolist()) for g in (0, 1, 2) for i in range(9)]
    x = spark.createDataFrame(items, "g bigint, b bigint, i bigint, v array<double>")
    q = spark.createDataFrame(queries, "g bigint, q bigint, v array<double>")
    for k in (1, 3):
        got = {}
        for r in V.nearest(q, x, "g", "q", "b", "i", "v", k).collect():
            got.setdefault((r.q, r.b), set()).add(r.ix)
        want = {(n, b): {i for _, i in sorted((-np.dot(v, w), i) for h, c, i, w in items if h == g and c == b)[:k]} for g, n, v in queries for b in (0, 1, 2) if g < 2}
        assert got == want
    best = {(r.ix, r.other): r.other_ix for r in V.unit_best(x, "g", "b", "i", "v").collect()}
    for g, b, i, v in items:
        for c in {0, 1, 2} - {b}:
            assert best[(i, c)] == max(((np.dot(v, w), -j) for h, d, j, w in items if h == g and d == c))[1] * -1


@pytest.mark.parametrize("most", [5, 10_000])
def test_places_among_a_reference(spark, most):
    rng = random.Random(3)
    ref = [round(rng.random(), 2) for _ in range(300)]
    df = spark.createDataFrame([(i, round(rng.random() * 1.4 - 0.2, 2)) for i in range(200)], "i int, s double")
    got = V.empirical_cdf(df, "s", spark.createDataFrame([(v,) for v in [*ref, None]], "v double"), "p", most).collect()
    assert len(got) == 200 and all(abs(r.p - sum(v <= r.s for v in ref) / 300) < 1e-12 for r in got)
    assert {r.p for r in V.empirical_cdf(df, "s", spark.createDataFrame([], "v double"), "p", most).collect()} == {0.0}


def test_best_documents_both_ways(spark, monkeypatch):
    rng = random.Random(4)
    w = spark.createDataFrame([(d, f"t{t}", rng.random()) for d in range(80) for t in rng.sample(range(12), 5)], "doc bigint, term string, w double")
    q = spark.createDataFrame([(k, f"t{t}", 1.0 + k % 2) for k in range(6) for t in rng.sample(range(14), 4)], "q bigint, term string, w double")
    sent = sorted((r.q, r["rank"], r.doc, r.score) for r in L.best_documents(q, w, "q", "doc", 7).collect())
    monkeypatch.setattr(L, "bounded_rows", lambda df: None)
    joined = sorted((r.q, r["rank"], r.doc, r.score) for r in L.best_documents(q, w, "q", "doc", 7).collect())
    assert sent == joined and len(sent) == 42


def test_answers_and_coverage(spark):
    p = spark.createDataFrame([("C1", "Assessment is by one written exam. The course has labs; they take two hours."), ("C2", None), ("C3", "Graphs are drawn with care.")], "k string, text string")
    q = spark.createDataFrame([(1, "Assessed by a written exam?"), (2, "zebra"), (3, None)], "q int, ask string")
    a = {r.q: r.sentence for r in T.answers(p, "k", "text", q, "q", "ask").collect()}
    assert a == {1: "Assessment is by one written exam."}
    t = spark.createDataFrame([("graph theory", "trees and paths", ["P", "Q"]), ("x", None, ["P"])], "topic string, description string, programmes array<string>")
    u = spark.createDataFrame([("P", "a", 0, "Paths in trees, graph theory"), ("P", "a", 1, None), ("R", "b", 0, "graph theory trees and paths")], "programme string, id string, i int, text string")
    c = {(r.topic, r.programme): (round(r.best, 6), r.covered) for r in T.topic_coverage(t, u, 0.5).collect()}
    assert c == {("graph theory", "P"): (0.8, True), ("graph theory", "Q"): (0.0, False), ("x", "P"): (0.0, False)}
    with pytest.raises(ValueError):
        T.search("other", lambda: p, lambda: p, "q", "k")


def test_alignment_and_tags(spark):
    units = spark.createDataFrame([("a", 0, "intro", ["p", "q", "r"]), ("a", 1, "", ["x"]), ("b", 0, "other", ["p", "q", "z"]), ("b", 1, "intro", ["p", "q", "r", "s"]), ("b", 2, "last", ["m"])], "id string, i int, title_key string, w array<string>")
    r = T.unit_alignment(spark.createDataFrame([("a", "b")], "id_a string, id_b string"), units).collect()
    assert [(x.i, x.j, x["rank"], x.candidates) for x in r] == [(0, 1, 1.0, 3)]
    tags = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t"), ("a", "u"), ("b", "u")], "id string, tag string")
    same = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2")], "id string, course string")
    s = {(x.id_a, x.id_b): (x.shared, x.score) for x in T.tag_pairs(tags, same).collect()}
    assert s == {("a", "b"): ("t; u", 1.0), ("a", "c"): ("t", 0.0), ("b", "c"): ("t", 1.0)}


def test_pages(spark):
    html = "<h1>Course</h1><p>About it (PDF - 1.2MB) see https://x.y/z</p><h2>Prerequisites</h2><p>Algebra &amp; 6.01</p><h2>Grading</h2><p>exam</p><h3>Learning goals</h3><p>Use it.</p>"
    cal = "<table><tr><th>LEC #</th><th>TOPICS</th></tr><tr><td>1</td><td>Lecture 1: Trees</td></tr><tr><td>2</td><td>Midterm exam</td></tr><tr><td>3</td><td>Trees</td></tr></table>"
    df = spark.createDataFrame([("a", html, cal), ("b", None, None), ("c", html, "<h2>Overview</h2><p>Kept text</p>")], "id string, syllabus string, calendar string")
    w = {r.key: r for r in W.page_courses(df).collect()}
    assert w["a"].prerequisites_text == "Algebra & 6.01" and w["a"].lecture_topics == ["Trees"] and w["a"].outcomes == ["Use it."]
    assert w["a"].syllabus_text == "About it see Use it." and w["b"].syllabus_text == "" and w["c"].syllabus_text.endswith("Kept text")
    x = spark.createDataFrame([("see 6.042 and 18.01A, CS.101", "18.01A"), (None, None)], "t string, own string")
    assert [r[0] for r in x.select(C.course_references(F.col("t"), F.col("own"))).collect()] == [["6.042", "CS.101"], []]
    t = spark.createDataFrame([(1, "w " * 60), (2, "W " * 60), (3, "short"), (4, None)], "k int, t string")
    assert [r.k for r in W.good_texts(t, "k", "t").collect()] == [1]


def test_texts_to_records(spark):
    df = spark.createDataFrame([("a", "One two three four.\n\nshort\n \nFive six seven eight nine."), ("b", None), ("c", "")], "k string, t string")
    r = {x.key: x for x in P.from_text(df, "k", "t").collect()}
    assert [u.text for u in r["a"].units] == ["One two three four.", "Five six seven eight nine."] and r["b"].units == [] and r["a"].course_name == "input course"
    units = P.units_of("Unit\nDescription\nDuration\n1\nAlpha: first things.\n2\n2\nBeta and more. 3. Gamma starts here\nwith 06 more\nTotal\n15")
    assert [(u["title"], u["hours"]) for u in units] == [("Alpha", 2), ("", None), ("", 6)] and units[2]["text"] == "Gamma starts here with more"
    said = P.outcomes_of("Students will be able to:\nDesign a schema for it (K6)  Explain the layers of it (L2, L3)\nthat are used\n● Learn to use")
    assert said == [{"text": "Design a schema for it", "k_levels": [6]}, {"text": "Explain the layers of it that are used", "k_levels": [2, 3]}, {"text": "Learn to use", "k_levels": []}]
    assert P.outcomes_of("1 Explain the first idea 2 Apply the second idea")[1]["text"] == "Apply the second idea" and P.outcomes_of("") == []
    assert P.clean_pages(["B. Tech AI / Semester-III / AY 2023-24 / Page 4\nText stays"]) == [("Text stays", "2023-24")]


def test_archives_and_templates(spark, tmp_path):
    def docx(text):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("word/document.xml", "".join(f"<w:p><w:t>{x}</w:t></w:p>" for x in text.split("\n")))
        return b.getvalue()

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("2ND YEAR / CS /one.docx", docx("First line &amp; more\n" + "x" * 300))
        z.writestr("exam_paper.docx", docx("no"))
        z.writestr("broken.docx", b"?")
        z.writestr("short.docx", docx("tiny"))
        z.writestr("notes.txt", "no")
    r = {x.path: (x.status, x.pages) for x in S.read_archives(spark, str(tmp_path / "*.zip"), S.docx_text, ".docx").collect()}
    assert r["2ND YEAR/CS/one.docx"][1][0].startswith("First line & more\nxxx") and {k: v[0] for k, v in r.items()} == {"2ND YEAR/CS/one.docx": "read", "broken.docx": "unreadable", "short.docx": "scanned"}
    t = spark.createDataFrame([("n {{a:0}} of {{b:2}} {{c:1}} {{a:0}}",), (None,)], "line string")
    m = spark.createDataFrame([("a", 1234.0), ("b", 0.5)], "name string, value double")
    assert [x.line for x in S.filled(t, "line", m).collect()] == ["n 1,234 of 0.50 {{c:1}} 1,234", None]


def test_overlap_of_empty_records(spark):
    units = spark.createDataFrame([("a", 0, "x", [1.0, 0.0]), ("a", 1, "y", []), ("b", 0, "z", [1.0, 0.0])], "id string, ix int, label string, vec array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "none")], "id_a string, id_b string")
    s = {r.id_b: r for r in O.pair_scores(pairs, units, 0.5).collect()}
    assert (s["b"].cov_a, s["b"].cov_b, s["b"].max_unit) == (0.5, 1.0, 1.0) and s["none"].soft == 0.0
    t = [(r.kind, r.topic, r.match) for r in O.pair_topics(pairs, units, 0.5).collect()]
    assert sorted(t) == [("common", "x", "z"), ("only a", "y", None)]


def test_phrases_changes_and_models(spark):
    df = spark.createDataFrame([("Strong experience with Docker and the new Kubernetes tools, good SQL",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(A.skill_phrases(F.col("t"))).collect()] == [["Docker", "Kubernetes tools", "SQL"], [], []]
    x = spark.createDataFrame([("alpha beta gamma delta",), (None,)], "t string")
    for kind in ("typos", "drop", "truncate"):
        a, b = ([r[0] for r in x.select(A.perturb(F.col("t"), kind, 0.5, 7)).collect()] for _ in range(2))
        assert a == b and a[1] == "" and a[0]
    a = np.random.default_rng(1).normal(size=(40, 3))
    v = a / np.linalg.norm(a, axis=1, keepdims=True)
    for tau in (0.3, 0.8):
        lab = A.average_linkage(v, tau)
        groups = [np.flatnonzero(lab == k) for k in set(lab)]
        mean = lambda g, h: float((v[g] @ v[h].T).mean())
        assert all(mean(g, h) < tau + 1e-9 for i, g in enumerate(groups) for h in groups[:i])
    rows = [(f"g{i % 20}", float(i % 2), float(i % 2) + 0.3 * math.sin(i)) for i in range(200)]
    m = models.fit_logistic(spark.createDataFrame(rows, "g string, y double, f double"), "y", ["f"], "g").first()
    assert m.f > 1 and m.cv_auc > 0.95 and m.n == 200
    assert models.fit_logistic(spark.createDataFrame([("g", 1.0, 1.0)], "g string, y double, f double"), "y", ["f"], "g").first().cv_auc is None
    texts = [(i, f"{'graph tree' if i % 2 else 'poem verse'} word{i % 7}", ["a"] if i % 2 else []) for i in range(120)]
    f = {r.label: r.f1 for r in models.one_against_rest(spark.createDataFrame(texts, "i int, t string, labels array<string>"), "t", "labels", ["a", "none"], "i").collect()}
    assert f["a"] == 1.0 and f["none"] == 0.0
    n = spark.createDataFrame([("algorithm design", ["Design", "Algorithms"])], "p string, n array<string>")
    assert n.select(Q.alias_met_any(F.col("p"), F.col("n")), Q.alias_met_any(F.col("p"), F.col("n"), single=False)).first() == (False, True)
