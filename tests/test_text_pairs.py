"""Pairs of texts against plain loops, and what they shuffle."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from syllaweave.operators import lexical as L, text_pairs as T

STOP = set(L.STOP_WORDS.split())


def brute(rows, least, ngrams):
    """Cosines of (group, doc, text) by loops; copies of a key add up, frequencies count every key."""
    docs = {}
    for g, k, t in rows:
        ws = [w for w in re.findall("[a-z0-9]{2,}", (t or "").lower()) if w not in STOP]
        docs.setdefault((g, k), []).extend(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])] * (ngrams == 2))
    n, df = len(rows), {}
    for ts in docs.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    vec = {}
    for key, ts in docs.items():
        v = {t: (1 + math.log(ts.count(t))) * (math.log((1 + n) / (1 + df[t])) + 1) for t in set(ts) if 2 <= df[t] <= 0.8 * n}
        size = math.sqrt(sum(x * x for x in v.values()))
        vec[key] = {t: x / size for t, x in v.items()}
    sims = {(a, b): sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) for a in vec for b in vec if a[0] is not None and a[0] == b[0] and None not in (a[1], b[1]) and a[1] < b[1]}
    return {(a[0], a[1], b[1]): s for (a, b), s in sims.items() if s >= least}


@pytest.mark.parametrize("ngrams, least, how", [(1, 0.3, {}), (2, 0.5, {}), (2, 0.3, {"block": 9}), (1, 0.6, {"block": 9}), (2, 0.4, {"bound": 0}), (1, 0.9, {"block": 25})])
def test_text_pairs_are_complete(spark, ngrams, least, how):
    rng = random.Random(4)
    draw = lambda: f"t{int(rng.paretovariate(0.7)) % 90}"
    rows = [(rng.choice(["x", "y", "z"]), k, " ".join(draw() for _ in range(rng.randrange(1, 30)))) for k in range(150)]
    rows += [(g, 200 + k, re.sub("t1 ", "The T1-é", rows[k][2]) + rng.choice(["", " und ı x"])) for k in range(40) for g in [rows[k][0]]]
    rows += [("x", 400, ""), ("x", 401, None), ("x", 402, "the of a"), (None, 403, rows[0][2]), ("x", None, rows[0][2]), ("y", 0 + 500, rows[3][2]), ("y", 500, rows[4][2])]
    df = spark.createDataFrame(rows, "g string, d long, t string")
    got = {(r.g, r.doc_a, r.doc_b): r.sim for r in T.text_pairs(df, "d", "g", F.col("t"), least, ngrams, **how).collect()}
    want = brute(rows, least, ngrams)
    near = lambda x: {k for k, s in x.items() if abs(s - least) > 1e-9}
    assert near(got) == near(want) and len(want) > 10 and all(abs(got[k] - want[k]) < 1e-9 for k in near(want))


def test_steps_do_not_change_the_pairs(spark, monkeypatch):
    rng = random.Random(9)
    df = spark.createDataFrame([("x", k, " ".join(f"t{rng.randrange(25)}" for _ in range(12))) for k in range(120)], "g string, d long, t string")
    run = lambda: sorted(tuple(r) for r in T.text_pairs(df.coalesce(1), "d", "g", F.col("t"), 0.5).withColumn("sim", F.round("sim", 9)).collect())
    whole = run()
    row, rank, w = [], [], []
    kept = T._pairs
    import numpy as np

    rng = np.random.default_rng(2)
    m = (rng.random((70, 30)) < 0.3) * rng.random((70, 30))
    m /= np.sqrt((m * m).sum(1))[:, None]
    row, rank = np.nonzero(m)
    want = {(a, b) for a in range(70) for b in range(a + 1, 70) if m[a] @ m[b] >= 0.4}
    for step in (1, 7, 100, 10_000):
        monkeypatch.setattr(T, "STEP", step)
        assert {(a, b) for x in kept(row, rank, m[row, rank], 70, None, 0.4) for a, b in zip(x[0], x[1])} == want
    assert whole and len(want) > 20


def test_tfidf_pairs_shuffle_no_vectors(spark, tmp_path):
    """Texts of 2.5 MB: their vectors and candidate pairs would be many times that."""
    from syllaweave.plans.lexical_queries import ov_tfidf_pairs

    rng = random.Random(1)
    words = ["w" + "".join(rng.choices("abcdefgh", k=7)) for _ in range(1_500)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(2_000)]
    texts += texts[:5]
    spark.createDataFrame([(k, "one", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    moved = lambda: sum(e.totalShuffleWrite() for e in [x.apply(i) for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for i in range(x.size())])
    before = moved()
    assert {(r.doc_a, r.doc_b) for r in ov_tfidf_pairs(spark, str(tmp_path)).collect()} >= {(k, 2_000 + k) for k in range(5)}
    assert 0 < moved() - before < 3 * sum(map(len, texts))


@pytest.mark.parametrize("alike", [30, 4])
def test_course_baseline_shuffles_no_vectors(spark, tmp_path, alike):
    """The twenty closest of 700 courses as in SQL, with more and with fewer than twenty pairs over the first bound."""
    import duckdb

    from syllaweave.plans.model_queries import ORACLE, red_course_baseline

    rng = random.Random(alike)
    words = ["w" + "".join(rng.choices("abcdefgh", k=7)) for _ in range(700)]
    texts = [" ".join(rng.choices(words, k=90)) for _ in range(700)]
    for k in range(alike):
        texts[k + 300] = texts[k]
    for k in range(60):
        texts[k + 400] = " ".join(texts[k + 100].split()[:60] + rng.choices(words, k=30))
    rows = [(f"v{k:03d}", f"key {k}", None, "C1", "2023-24", "III", "", [f"2/{p}/a.pdf" for p in ("IT", "CIVIL")[: 1 + k % 2]], 1, "", [(t[:200], [1])], [("a", t[200:], 1)]) for k, t in enumerate(texts)]
    kinds = "id string, course_key string, course_name string, code string, academic_year string, semester string, program string, source_files array<string>, n_source_files int, objectives string, outcomes array<struct<text: string, k_levels: array<int>>>, units array<struct<title: string, text: string, hours: int>>"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/courses_small.parquet")
    moved = lambda: sum(e.totalShuffleWrite() for e in [x.apply(i) for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for i in range(x.size())])
    before = moved()
    got = sorted(tuple(r) for r in red_course_baseline(spark, str(tmp_path)).collect())
    took = moved() - before
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW courses_small AS SELECT * FROM '{tmp_path}/courses_small.parquet/*.parquet'")
        assert got == sorted(c.execute(ORACLE["red_course_baseline"]).fetchall()) and len(got) == 20
    assert 0 < took < 6 * sum(map(len, texts))
