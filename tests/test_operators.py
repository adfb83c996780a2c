"""Operators on small fixtures: families, schedules, differences, measures, parsers, assembly."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from syllaweave.operators import assemble as A, catalog as K, diff as D, lexical as L, metrics as M, parse as P, prerequisites as Q, vectors as V
from syllaweave.operators.graph import components

BLOCK = """Program: B. Tech (Computer Engineering)
Semester : V
Course/Module : Synthetic Networks
Module Code: 702CE0C099
Teaching Scheme
Lecture
Practical
Tutorial
Credit
3
2
0
4
Marks
Pre-requisite:
Course Objective:
The course would enable students to understand how packets move through a network.
Course Outcomes:
After completion of the course, students will be able to:
1. Explain the layers of the network stack (K2)
2. Configure routing on a small network (K3)
Detailed Syllabus:
Unit
Description
Duration
1
Network layers: OSI and TCP/IP models, encapsulation.
08
2
Routing: distance vector and link state routing, OSPF.
07
Total
15
Text Books:
1. A. Author, Networks, 1st Edition, Publisher, 2020.
"""


def test_families(spark):
    df = spark.createDataFrame([("nm01", "networks", "C1"), ("nm02", "computernetworks", "C1"), ("nm03", "computernetworks", ""), ("nm04", "algebra", "C9"), ("nm05", None, None)], "id string, course_key string, code string").withColumn("course_name", F.lit(None).cast("string"))
    f = {r.id: r.family for r in K.families(df).collect()}
    assert f["nm01"] == f["nm02"] == f["nm03"] == "f01" and f["nm04"] == "f04" and f["nm05"] == "f05"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a int, b int"), "a", "b").collect()}
    assert got == {n: root[n] for a, b in edges if a != b for n in (a, b)}


def test_components_star_and_path(spark):
    e = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a int, b int"), "a", "b").collect()}
    assert len(got) == 3201 and {got[i] for i in range(3000)} == {0} and {got[i] for i in range(5000, 5201)} == {5000}


def test_split_keeps_families(spark):
    s = K.split_by_rank(spark.range(400).select(F.concat(F.lit("f"), F.col("id") % 37).alias("family"))).collect()
    assert len(s) == 37 and {r.split for r in s} == {"train", "val", "test"}


SCHEDULE = [("COMP", 1, "f1"), ("COMP", 1, "g1"), ("COMP", 1, "g2"), ("COMP", 2, "h1"), ("COMP", 2, "h2"), ("COMP", 2, "h3"), ("COMP", 3, "f2")]


def test_prerequisite_flags(spark):
    st_ = spark.createDataFrame(SCHEDULE, "programme string, sem int, family string")
    covered = Q.coverage(st_, spark.createDataFrame([("COMP", 60), ("IT", 1)], "programme string, n bigint"))
    assert {(r.programme, r.sem) for r in covered.collect()} >= {("COMP", 1), ("COMP", 2), ("COMP", 3)} and covered.filter("programme = 'IT' or sem = 4").count() == 0
    ph = spark.createDataFrame([("COMP", "f2", 3, p, p.lower().replace(" ", "")) for p in ("Programming in C", "Discrete Mathematics")], "programme string, family string, sem int, phrase string, phrase_key string")
    names = spark.createDataFrame([("programminginc", "f1")], "phrase_key string, resolved_family string")
    assert [(r.phrase, r.type) for r in Q.flags(ph, names, Q.earlier(st_)).collect()] == [("Discrete Mathematics", "unresolved")]
    gone = Q.flags(ph, names, Q.earlier(st_.filter("family <> 'f1'"))).collect()
    assert {(r.phrase, r.type) for r in gone} == {("Discrete Mathematics", "unresolved"), ("Programming in C", "not_offered_earlier")}


def test_diff(spark):
    snap = spark.createDataFrame([("P", "a", "f1", "Data Structures"), ("P", "a", "f2", "Operating Systems"), ("P", "b", "f1", "Data Structures"), ("P", "b", "f3", "Principles of Operating Systems")], "programme string, ay string, family string, course_name string")
    pairs = spark.createDataFrame([("P", "a", "b")], "programme string, ay string, next_ay string")
    d = D.by_name(snap, pairs)
    assert {(r.change, r.family_a, r.family_b) for r in d.collect()} == {("retained", "f1", "f1"), ("removed", "f2", None), ("added", None, "f3")}
    s = D.score(d, D.true_changes(snap, pairs)).first()
    assert (s.tp, s.claimed, s.real) == (2, 2, 2)
    c = spark.createDataFrame([("g", "a1", "b1", 0.9), ("g", "a1", "b2", 0.8), ("g", "a2", "b1", 0.85), ("g", "a2", "b2", 0.5)], "g string, a string, b string, s double")
    m = D.greedy_match(c, ["g"], "g string, a string, b string, s double").collect()
    assert {(r.a, r.b) for r in m} == {("a1", "b1"), ("a2", "b2")}


def test_measures(spark):
    df = spark.createDataFrame([(1, bool(y), s) for y, s in ((0, 0.1), (0, 0.2), (1, 0.3), (1, 0.8), (1, 0.9))], "g int, y boolean, s double")
    b = M.best_threshold(df, "y", "s", ["g"]).first()
    assert (b.threshold, b.f1) == (0.3, 1.0)
    assert M.auc(df, "y", "s", ["g"]).first().auc == 1.0
    assert abs(M.average_precision(df, "y", "s", ["g"]).first().ap - 1.0) < 1e-12
    p = M.prf(df, "y", F.col("s") >= 2, ["g"]).first()
    assert (p.precision, p.recall) == (None, 0.0)
    one = df.filter("y")
    assert M.auc(one, "y", "s", ["g"]).first().auc is None
    k = M.kappa(spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "b"), (None, "a")], "x string, y string"), "x", "y").first()
    assert k.n == 3 and abs(k.kappa - 0.4) < 1e-9
    ci = M.bootstrap_mean(spark.range(200).select((F.col("id") % 20).alias("g"), (F.col("id") % 2).cast("double").alias("v")), "v", "g").first()
    assert ci.low <= ci.value == 0.5 <= ci.high
    assert M.kappa(spark.createDataFrame([], "x string, y string"), "x", "y").first().kappa is None


def test_maxsim_identity_and_blocks(spark):
    rows = [(0, o, o * 10 + i, [1.0 if j == i else 0.0 for j in range(3)]) for o in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "g bigint, o bigint, u bigint, v array<double>")
    m = V.maxsim(V.unit_best(df, "g", "o", "u", "v"), 0.5).first()
    assert (m.cov_a, m.cov_b, m.overlap, m.soft) == (1.0, 1.0, 1.0, 1.0)
    rng = np.random.default_rng(0)
    big = [(0, int(i % 7), int(i), rng.normal(size=4).tolist()) for i in range(300)]
    saved, V.BLOCK = V.BLOCK, 64
    try:
        got = {(r.ix_a, r.ix_b): r.sim for r in V.unit_pairs(spark.createDataFrame(big, "g bigint, o bigint, u bigint, v array<double>"), "g", "o", "u", "v", 3.0).collect()}
    finally:
        V.BLOCK = saved
    want = {}
    for _, o, i, v in big:
        for _, p, j, w in big:
            if (o, i) < (p, j) and o != p and np.dot(v, w) >= 3.0:
                want[(i, j)] = float(np.dot(v, w))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_prefix_filter_is_complete(spark):
    rng = np.random.default_rng(1)
    docs = [(i, i % 2, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 60)) for i in range(80)]
    df = spark.createDataFrame(docs, "d int, g int, t string")
    w = L.tfidf(L.counts(df, ["g", "d"], F.col("t")), ["g", "d"], 80, min_df=1, max_df=1.0)
    got = {(r.doc_a, r.doc_b) for r in L.cosine_pairs(w, "d", "g", 0.6).collect()}
    vec = {}
    for r in w.collect():
        vec.setdefault((r.g, r.d), {})[r.term] = r.w
    want = {(a, b) for g, a in vec for h, b in vec if g == h and a < b and sum(x * vec[(h, b)].get(t, 0) for t, x in vec[(g, a)].items()) >= 0.6}
    assert got == want and want


def test_parse_block_and_pages(spark):
    lines = [(x, "2025-26") for x in BLOCK.splitlines()]
    r = P.record(lines, "x.pdf")
    assert r["prerequisites"] == "" and r["objectives"].startswith("The course would enable")
    assert [o["k_levels"] for o in r["outcomes"]] == [[2], [3]] and [u["hours"] for u in r["units"]] == [8, 7] and r["credits"] == 4
    assert P.record([(x, None) for x in BLOCK.replace("Pre-requisite:", "Pre-requisite: Computer Networks").splitlines()], "x")["prerequisites"] == "Computer Networks"
    tail = P.record([(x, None) for x in (BLOCK + "Details of Term work:\nAttendance 10 marks\n").splitlines()], "x")
    assert "Attendance" not in str(tail)
    footer = "\nB Dept handbook page {}\n"
    df = spark.createDataFrame([("a", [BLOCK + footer.format(1), "more" + footer.format(2)]), ("b", None), ("c", [""])], "path string, pages array<string>")
    got = P.parse_pages(df).collect()
    assert len(got) == 1 and got[0].course_key == "syntheticnetworks" and "handbook" not in got[0].text_books
    assert P.keep_recent(P.parse_pages(df)).count() == 0  # no year on these pages


def test_html(spark):
    page = "<nav><ul><li>x</li></ul></nav><h1>A &amp; B</h1><p>one <b>two</b></p><script>no</script><table><tr><th>Topic</th><th>N</th></tr><tr><td>Lecture 1: Sets</td><td>3</td></tr></table><h2>C</h2><ul><li>p</li><li>q</li></ul>"
    df = spark.createDataFrame([("k", page), ("n", None)], "id string, html string")
    assert [(r.heading, r.text) for r in P.html_sections(df, "id", "html").orderBy("position").collect()] == [("A & B", "one two"), ("C", "p q")]
    assert [r.cell for r in P.html_table_column(df, "id", "html", "topic").collect()] == ["Sets"]


def test_linkage_and_perturbation(spark):
    v = np.array([[1, 0], [0.99, 0.1], [0, 1.0]])
    assert A.average_linkage(v / np.linalg.norm(v, axis=1, keepdims=True), 0.9).tolist() == [0, 0, 1]
    df = spark.createDataFrame([("a b c d e f g h i j",), (None,)], "t string")
    assert [r[0] for r in df.select(A.perturb(F.col("t"), "truncate", 0.5, 1)).collect()] == ["a b c d e", ""]
    with pytest.raises(ValueError):
        A.perturb(F.col("t"), "x", 0.1, 1)


def test_rouge(spark):
    r = A.rouge_n(F.lit("a b c a"), F.lit("a a a d"), 1)
    x = spark.range(1).select(r["precision"], r["recall"], A.rouge_l(F.lit("a b c d"), F.lit("a c x d"))).first()
    assert x[0] == 0.5 and x[1] == 0.5 and abs(x[2] - 0.75) < 1e-12


def test_flags_of_the_second_rule_set(spark):
    from syllaweave.operators import prerequisites as P

    e = spark.createDataFrame([("1", "f1", "Data Structures"), ("2", "f2", "Compiler Design"), ("3", "f3", "Operating System Design"), ("4", "f4", "Quantum Optics Lab")], "id string, family string, course_name string")
    first = spark.createDataFrame([("P", "f1", 1), ("P", "f2", 5), ("P", "f3", 2), ("P", "f4", 6)], "programme string, family string, first_sem int")
    phrases = ["Parsing automata", "Graph traversal", "Quantum optic laboratory lab", "Medieval poetry", "Operating systems design", "Skills of all kinds"]
    ph = spark.createDataFrame([("P", "f2", "Compiler Design", 5, p, p.lower().replace(" ", "")) for p in phrases], "programme string, family string, course_name string, sem int, phrase string, phrase_key string")
    own = spark.createDataFrame([("P", "f2", "automata parsing")], "programme string, family string, text string")
    taught = spark.createDataFrame([("f1", "graph traversal orders"), ("f4", "medieval poetry")], "family string, text string")
    got = {(r.phrase, r.resolved_family, r.type) for r in P.flags_v2(ph, P.exact_names(e), first, e, own, taught).collect()}
    assert got == {("Quantum optic laboratory lab", "f4", "not_offered_earlier"), ("Medieval poetry", None, "assumed_topic_not_taught")}
