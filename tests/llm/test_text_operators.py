"""Packing, leakage, consensus, splits and the canonical list against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from syllaweave.llm import canonical, consensus, leakage, packing, splits


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200), st.integers(1, 9))
def test_best_fit_never_overfills_and_fits_best(sizes, most):
    b, used, open_ = packing.BestFit(50, most), {}, {}
    for s in sizes:
        fits = [f for f in open_.values() if f >= s]
        n = b.put(s)
        used[n] = used.get(n, 0) + s
        if fits:
            assert n in open_ and open_.pop(n) == min(fits)
        else:
            assert used[n] == s
            if len(open_) == most:
                least = min(open_.values())
                gone = next(k for k in open_ if open_[k] == least and k not in {x for v in b.at.values() for x in v})
                open_.pop(gone)
        if used[n] < 50:
            open_[n] = 50 - used[n]
        assert len(open_) <= most and used[n] <= 50


def test_pack(spark):
    rng = random.Random(1)
    texts = [" ".join("w" for _ in range(rng.randrange(0, 300))) for _ in range(800)] + ["w " * 1024, "w " * 2500, "", None, "a.b"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc int, text string").withColumn("tokens", F.lit("x")).withColumn("container", F.lit(1))
    p = packing.pack(df, "doc", packing.token_count(F.col("text")), containers_per_stream=40).collect()
    per = {}
    for r in p:
        per.setdefault(r.key, []).append((r.token_from, r.token_to))
    assert all(sorted(v)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:])) for v in per.values()) and len(per) == len(texts)
    n = {i: len(re.findall(r"\w+|[^\w\s]+", t or "")) for i, t in enumerate(texts)}
    assert all(max(e for _, e in per[i]) == n[i] for i in n) and {i for i, v in per.items() if len(v) > 1} == {801}
    use = {}
    for r in p:
        use[r.container] = use.get(r.container, 0) + r.token_to - r.token_from
    assert max(use.values()) <= 1024 and sum(use.values()) / (1024 * len(use)) > 0.85
    assert packing.pack(df.limit(0), "doc", packing.token_count(F.col("text"))).count() == 0


def test_leaks_against_windows(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 20)
    rng = random.Random(2)
    text = lambda n: [f"t{rng.randrange(60)}" for _ in range(n)]
    items = [text(rng.randrange(10, 48)) for _ in range(60)]
    docs = []
    for i in range(150):
        d = text(rng.choice([0, 3, 16, 40, 120, 900]))
        if i % 2:
            w = rng.choice(items)
            k = rng.randrange(len(w))
            at = rng.randrange(len(d) + 1)
            d = d[:at] + w[k : k + rng.choice([14, 15, 16, 30])] + d[at:]
        docs.append(" ".join(d).upper())
    rows = [*enumerate([*docs, None, "", " ".join(text(30_000)) + " " + " ".join(items[0])])]
    df = spark.createDataFrame([*rows, rows[1]], "d int, t string").withColumn("item", F.lit("x"))
    it = spark.createDataFrame([*((i, ", ".join(w)) for i, w in enumerate(items)), (99, None), (98, "too few words")], "i int, p string")
    got = {(r.key, r.item) for r in leakage.leaks(df, "d", "t", it, "i", "p").collect()}
    grams = {}
    for i, w in enumerate(items):
        for k in range(len(w) - 14):
            grams.setdefault(tuple(w[k : k + 15]), set()).add(i)
    want = {(d, i) for d, t in rows for w in [re.findall("[a-z0-9]+", (t or "").lower())] for k in range(len(w) - 14) for i in grams.get(tuple(w[k : k + 15]), ())}
    assert got == want and len(want) > 20
    assert leakage.leaks(df, "d", "t", it.limit(0), "i", "p").count() == 0


VOTES = "item string, pass1 string, pass2 string, pass3 string, pass1_by string, pass2_by string, pass3_by string, consensus string"
PASSES = [(f"pass{i}", f"pass{i}_by") for i in (1, 2, 3)]


def simulated(n, seed):
    rng = random.Random(seed)
    right = {"A": 0.95, "B": 0.8, "C": 0.6}
    truth, rows = {}, []
    for i in range(n):
        truth[f"i{i}"] = y = rng.choice(["correct", "wrong"])
        other = {"correct": "wrong", "wrong": "correct"}[y]
        rows.append((f"i{i}", *(y if rng.random() < right[r] else other for r in "ABC"), "a", " B", "C ", None))
    return truth, rows


@pytest.mark.parametrize("bound", [50_000, 0])
def test_consensus_recovers_truth_and_raters(spark, bound):
    truth, rows = simulated(600, 5)
    v = consensus.votes(spark.createDataFrame(rows, VOTES), "item", PASSES, ["correct", "wrong"])
    c = consensus.fit(v, ["correct", "wrong"], bound=bound, max_rounds=25)
    got = {r.item: r.label for r in c.posterior.collect()}
    vote = {r[0]: max("correct wrong".split(), key=r[1:4].count) for r in rows}
    accuracy = lambda x: sum(x[k] == truth[k] for k in truth) / len(truth)
    assert accuracy(got) >= accuracy(vote) > 0.85
    r = {x.rater: x for x in c.raters.collect()}
    assert r["A"].reliability > r["B"].reliability > r["C"].reliability and all(x.low < x.reliability < x.high for x in r.values())


def test_votes_support_and_agreement(spark):
    rows = [("a", "C", "[correct]", "?", "R", "S", "T", "Cor."), ("b", "w", "correct", None, "R", "S", "", "correct"), ("c", None, "", "skip", "R", "S", "T", None), ("d", '"wrong"', "wro", "c", "R", "S", "T", "uncertain")]
    df = spark.createDataFrame([*rows, rows[0]], VOTES)
    s = {r.item: (r.label, r.stored) for r in consensus.supported(df, "item", ["pass1", "pass2", "pass3"], "consensus", ["correct", "wrong"]).collect()}
    assert s == {"a": ("correct", "correct"), "b": ("uncertain", "correct"), "c": ("uncertain", "uncertain"), "d": ("wrong", "uncertain")}
    v = consensus.votes(df, "item", PASSES, ["correct", "wrong"])
    k = consensus.krippendorff(v).first()
    # coincidences: a: cc 2; b: wc 1, cw 1; d: ww 1, wc 1, cw 1 (of three votes)
    assert (k.items, k.votes) == (3, 7) and abs(k.agreement - (2 + 1) / 7) < 1e-9
    none = v.limit(0)
    assert consensus.krippendorff(none).first().alpha is None
    f = consensus.fit(none, ["correct", "wrong"])
    assert f.posterior.count() == 0 and f.raters.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(1, 8))
def test_differencing_is_balanced(weights, bins):
    at = splits.differencing(weights, bins)
    total = [0] * bins
    for w, b in zip(weights, at):
        total[b] += w
    assert sum(total) == sum(weights) and max(total) <= max(max(weights), sum(weights) / bins + max(weights))


def test_splits(spark, monkeypatch):
    monkeypatch.setattr(splits, "SHARD", 64)
    rng = random.Random(6)
    rows = [(f"v{i}", f"k{rng.randrange(150)}" if i % 9 else None, rng.choice([None, f"C{rng.randrange(400)}", ""])) for i in range(1500)] + [(f"h{i}", "hot", "C9999") for i in range(750)]
    df = spark.createDataFrame([*rows, rows[0]], "id string, k string, c string").withColumn("root", F.lit(1)).withColumn("bin", F.lit("x"))
    out = splits.assign(df, "id", F.col("k"), F.col("c"), {"train": 0.6, "val": 0.2, "test": 0.2}).collect()
    assert len(out) == len(rows)
    side = {r.key: r.split for r in out}
    for col in (1, 2):
        seen = {}
        for r in rows:
            if r[col]:
                assert seen.setdefault(r[col], side[r[0]]) == side[r[0]]
    codes = {}
    for r in out:
        codes.setdefault(r.group, set()).add(r.group_code)
    assert all(len(c) == 1 for c in codes.values()) and {r.group_code for r in out if r.key.startswith("h")} == {"C9999"}
    n = {s: list(side.values()).count(s) / len(side) for s in ("train", "val", "test")}
    assert sum(n.values()) == 1 and n["train"] >= 0.5
    assert splits.assign(df.limit(0), "id", F.col("k"), F.col("c"), {"train": 1.0}).count() == 0
    levels = splits.balanced_bins(spark.range(1000).select(F.col("id").cast("string").alias("item"), F.lit(1).cast("bigint").alias("weight")), bins=10, shard=64).groupBy("bin").count().collect()
    assert len(levels) == 10 and max(r["count"] for r in levels) - min(r["count"] for r in levels) <= 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", max_size=12), min_size=1, max_size=40, unique=True), st.lists(st.text("abc", max_size=12), min_size=1, max_size=8), st.integers(0, 3))
def test_tree_returns_all_within_radius(names, queries, r):
    t = canonical.BKTree(sorted(names))
    got = {(int(q), t.names[e], int(d)) for q, e, d in zip(*t.search(queries, np.full(len(queries), r)))}
    want = {(i, x, canonical.slow_distance(q, x)) for i, q in enumerate(queries) for x in names if canonical.slow_distance(q, x) <= r}
    assert got == want


def test_tree_with_long_names():
    long = "ab" * 60
    t = canonical.BKTree([long, "abc"])
    assert {(int(q), int(e)) for q, e, _ in zip(*t.search([long + "c", "abd"], np.array([2, 1])))} == {(0, 0), (1, 1)}


LIST = [(1, "Engineering Mathematics I", 0), (2, "Engineering Mathematics II", 0), (3, "Wireless Processing", 0), (4, "Stochastic Fault Diagnosis", 0), (5, "Packaging Planning and Management", 0), (3, "Signal Systems Design", 1), (6, "Urban Materials", 0), (7, "Urban Measurements", 0), (8, "Heat, Mass and Momentum Transfer", 0)]
TYPED = {
    "engg. mathematecs - II": 2, "Engineering Mathematics Part 1": 1, "Processing, Wireless": 3, "diagnosis of stochastic fault": 4, "Basics of Packaging Planing & Mgmt": 5, "PPM": 5, "signal syst. desing": 3,
    "Urban Meas.": 7, "urban material": 6, "hmmt": 8, "Pottery Workshop": 0, "": 0, None: 0, "x" * 5000: 0, "Engineering Mathematics": 0, "WIRELESS PROUESSSING course": 3,
}


NAMES = ["Applied Physics", "Applied Phonetics", "Machine Learning", "Master Logic", "Physics I", "Physics II", "Physics", "Data Structures", "Digital Signals", "Data Science"]


@pytest.mark.parametrize("shard", [20_000, 3])
def test_values_to_entries(spark, shard):
    df = spark.createDataFrame([(i, v, "c") for i, v in enumerate(TYPED)], "i int, v string, entry string")
    e = spark.createDataFrame([*LIST, (None, "No number", 0), (9, None, 1)], "entry bigint, name string, rank int")
    got = {r.i: r.entry for r in canonical.map_values(df, "v", e, shard).collect()}
    assert [got[i] for i in range(len(TYPED))] == list(TYPED.values())
    assert canonical.map_values(df.limit(0), "v", e).count() == 0
    assert {r.entry for r in canonical.map_values(df, "v", e.limit(0)).collect()} == {0}
    assert "entry_in" in canonical.map_values(df, "v", e).columns


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(NAMES), st.integers(0, 1)), max_size=14), st.lists(st.sampled_from([*NAMES, "Appl Ph", "ML", "M L", "aplied phisics", "Intro to Physics II", "phys", "", "zz"]), max_size=6), st.integers(1, 50))
def test_shards_change_nothing(names, values, shards):
    entries = [(i + 1, n, r) for i, (n, r) in enumerate(names)]
    whole = canonical.Catalogue(entries).match(values)
    parts = [canonical.Catalogue([e for e in entries if hash((e[0], shards)) % shards == k]).candidates(values) for k in range(shards)]
    assert [canonical.decide([p[i] for p in parts]) for i in range(len(values))] == whole


def test_ambiguous_over_shards(spark):
    e = spark.createDataFrame([(1, "Applied Physics", 0), (2, "Applied Phonetics", 0), (3, "Machine Learning", 0), (4, "Master Logic", 0)], "entry bigint, name string, rank int")
    df = spark.createDataFrame([(v,) for v in ("Appl Ph", "ML", "ML", "Applied Physic")], "v string")
    for shard in (1, 2, 3, 20_000):
        got = sorted((r.v, r.entry) for r in canonical.map_values(df, "v", e, shard).collect())
        assert got == [("Appl Ph", 0), ("Applied Physic", 1), ("ML", 0), ("ML", 0)]


def test_a_key_in_two_groups_joins_them(spark):
    rows = [("a", "x", "C1"), ("a", "y", "C2"), ("b", "x", None), ("c", "y", None), ("d", "z", "C3")]
    df = spark.createDataFrame(rows, "id string, k string, c string")
    out = {r.key: (r.group, r.group_code) for r in splits.assign(df, "id", F.col("k"), F.col("c"), {"train": 0.5, "test": 0.5}).collect()}
    assert out["a"] == out["b"] == out["c"] and out["a"][1] == "C1" and out["d"][1] == "C3" and len(out) == 4


@pytest.mark.parametrize("block", [1, 5_000])
def test_leaks_of_listed_and_of_joined_items(spark, block, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", block)
    rng = random.Random(12)
    text = lambda n: [f"t{rng.randrange(80)}" for _ in range(n)]
    items = [text(rng.randrange(12, 40)) for _ in range(30)]
    docs = [text(rng.choice([0, 14, 15, 70, 400])) for _ in range(60)]
    for d in docs[::2]:
        i = rng.choice(items)
        k, n = rng.randrange(len(i)), rng.randrange(12, 20)
        d[len(d) // 2 : len(d) // 2] = i[k : k + n]
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)] + [(99, None)], "doc long, text string")
    e = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(None, "x"), (77, None)], "item long, text string")
    got = {(r.key, r.item) for r in leakage.leaks(df, "doc", "text", e, "item", "text").collect()}
    spans = lambda w: {tuple(w[i : i + 15]) for i in range(len(w) - 14)}
    assert got == {(k, j) for k, d in enumerate(docs) for j, i in enumerate(items) if spans(d) & spans(i)} and len(got) > 8


def test_consensus_against_numpy(spark):
    """The posterior, the reliability and the rounds of the model against plain loops."""
    rng = np.random.default_rng(3)
    labels, raters = ["correct", "wrong"], ["A", "B", "C", "D"]
    right = {"A": 0.95, "B": 0.8, "C": 0.6, "D": 0.3}
    votes = []
    for i in range(120):
        truth = int(rng.random() < 0.4)
        for r in rng.choice(raters, 3, replace=False):
            votes.append((f"i{i:03d}", str(r), labels[truth if rng.random() < right[r] else 1 - truth]))
    df = spark.createDataFrame([(i, k, r, x) for k, (i, r, x) in enumerate(votes)], "item string, pass int, rater string, label string")
    got = consensus.fit(df, labels)
    dg = lambda x: float(consensus._digamma(np.array([x]))[0])
    by_item = {}
    for i, r, x in votes:
        by_item.setdefault(i, []).append((r, labels.index(x)))
    q = {i: np.array([sum(x == k for _, x in v) + 0.5 for k in (0, 1)]) for i, v in by_item.items()}
    q = {i: p / p.sum() for i, p in q.items()}
    before = None
    for _ in range(60):
        a = {r: np.array([[4.0, 1.0], [1.0, 4.0]]) for r in raters}
        s = np.ones(2)
        for i, v in by_item.items():
            s = s + q[i]
            for r, x in v:
                a[r][:, x] += q[i]
        e = {r: np.array([[dg(m[k, x]) - dg(m[k].sum()) for x in (0, 1)] for k in (0, 1)]) for r, m in a.items()}
        share = np.array([dg(s[k]) - dg(s.sum()) for k in (0, 1)])
        for i, v in by_item.items():
            z = share + sum(e[r][:, x] for r, x in v)
            q[i] = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        level = sum(float((a[r] * e[r]).sum()) for r in raters)
        if before is not None and abs(level - before) <= 1e-5 * abs(level):
            break
        before = level
    for r in got.posterior.collect():
        assert abs(r.probability - q[r.item].max()) < 1e-6 and (abs(q[r.item][0] - 0.5) < 1e-6 or r.label == labels[int(q[r.item].argmax())])
    w = s / s.sum()
    for r in got.raters.collect():
        m = a[r.rater]
        assert abs(r.reliability - sum(w[k] * m[k, k] / m[k].sum() for k in (0, 1))) < 1e-6 and r.low < r.reliability < r.high


def test_equal_raters_give_the_label_of_most_votes(spark):
    from syllaweave.llm.queries import TIED

    cases = {"a": "ccc", "b": "ccw", "c": "cw", "d": "ww", "e": "w", "f": "wwc", "g": "cc"}
    rows = [(i, k, f"R{(k + len(i) * n) % 5}", {"c": "correct", "w": "wrong"}[x]) for n, (i, v) in enumerate(cases.items()) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "item string, pass int, rater string, label string")
    got = {r.item: (r.label, r.probability, r.n_votes) for r in consensus.fit(df, ["correct", "wrong"], **TIED).posterior.collect()}
    sure = {i: x for i, (x, p, n) in got.items() if n >= 2 and p > 0.5 + 1e-6}
    assert sure == {"a": "correct", "b": "correct", "d": "wrong", "f": "wrong", "g": "correct"} and abs(got["c"][1] - 0.5) < 1e-6


def test_ties_stay_uncertain_in_many_items(spark, tmp_path):
    """A label that nearly all of 9,000 items have decides neither an item with one vote for each label nor one with one vote."""
    from syllaweave.llm.queries import p6_found

    rows = [(f"i{i}", "correct", "correct", "correct", "A", "B", "C", "correct") for i in range(9_000)]
    rows += [("tie", "correct", "wrong", None, "A", "B", "C", "uncertain"), ("one", "correct", None, "", "A", "B", "C", "correct"), ("most", "wrong", "c", "w", "A", "B", "C", "correct")]
    spark.createDataFrame(rows, VOTES).write.parquet(f"{tmp_path}/jdskills_llm.parquet")
    assert sorted(tuple(r) for r in p6_found(spark, str(tmp_path)).collect()) == [("most", "wrong"), ("one", "uncertain")]
