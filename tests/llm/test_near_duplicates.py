"""Near duplicates, cross-split overlaps and long repeats against brute force, with empty, null, repeated and huge rows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from syllaweave.llm import batch, cross_split as cs, long_repeats as lr, near_duplicates as nd


def words(t):
    return set(re.findall("[a-z0-9]+", (t or "").lower()))


def jac(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def corpus(n, seed, size=40, vocabulary=400, turn=False):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(size)] for _ in range(n // 4)]
    out = []
    for b in base:
        for k in range(4):
            w = list(b)
            for _ in range(k * 2):
                w[rng.randrange(len(w))] = f"w{rng.randrange(vocabulary)}"
            if k == 3 and turn:  # phrases in another order
                w = w[size // 2 :] + w[: size // 2]
            elif k == 3:
                rng.shuffle(w)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("threshold", "bucket", "large"), [(0.75, 16, 4096), (0.8, 16, 4096), (0.75, 16, 3), (0.75, 2048, 4096), (0.75, 2048, 7)])
def test_chosen_path_against_all_pairs(spark, threshold, bucket, large, monkeypatch):
    """Buckets that are compared whole, that are split on their rarest words, and that are compared as blocks."""
    monkeypatch.setattr(nd, "BUCKET", bucket)
    monkeypatch.setattr(nd, "LARGE", large)
    texts = [*corpus(160, 1), "", None, "one two", "one two", "One, TWO!", "x " * 5, "long " + " ".join(f"z{i}" for i in range(20_000))]
    rows = [(f"k{i:03d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], (None, "one two")], "key string, text string").withColumn("sid", F.lit(1)).withColumn("n", F.lit("x"))
    got = {(r.key_a, r.key_b) for r in nd.key_pairs(*nd.near_duplicates(df, "key", F.col("text"), threshold, runs=20)).collect()}
    want = {(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if words(s) and words(t) and jac(words(s), words(t)) >= threshold}
    assert got == want and len(want) > 40


@pytest.mark.parametrize(("large", "dense"), [(32, 1000), (32, 0), (10_000, 0), (10_000, 32)])
def test_a_notice_in_a_third_of_the_records(spark, large, dense, monkeypatch):
    """Its words stand together, so its bucket is far larger than its path predicts; nothing is lost and copies stay one class."""
    monkeypatch.setattr(nd, "BUCKET", 8)
    monkeypatch.setattr(nd, "LARGE", large)
    monkeypatch.setattr(nd, "DENSE", dense)
    monkeypatch.setattr(nd, "WIDE", 10)
    monkeypatch.setattr(nd, "BLOCK", 16)
    notice = " ".join(f"n{i}" for i in range(30))
    texts = [t + " " + notice if i // 4 % 3 == 0 else t for i, t in enumerate(corpus(600, 6, 40, 3000))] + [notice] * 200
    rows = [(f"k{i:03d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key string, text string").repartition(7)
    members, pairs = nd.near_duplicates(df, "key", F.col("text"), 0.75)
    got = {(r.key_a, r.key_b) for r in nd.key_pairs(members, pairs).collect()}
    sets = [(k, words(t)) for k, t in rows]
    want = {(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2) if jac(s, t) >= 0.75}
    assert got <= want and len(want - got) <= 1


@pytest.mark.parametrize(("large", "dense"), [(4, 1000), (5, 1000), (1000, 1000), (1000, 2)])
def test_streamed_buckets_give_each_pair_once(large, dense, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(nd, "DENSE", dense)
    monkeypatch.setattr(nd, "WIDE", 8)
    rng = np.random.default_rng(4)
    path = np.sort(rng.integers(-3, 3, 60))
    sid, s1 = np.arange(60), rng.integers(-(2**62), 2**62, 60)
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (path, sid, s1, s1 * 0)], ["path", "sid", *nd.SKETCH])
    for step in (1, 7, 60):
        out = pa.Table.from_batches(nd.compare(128, large)(rows.slice(i, step) for i in range(0, 60, step))).to_pylist()
        size = {p: int((path == p).sum()) for p in set(path.tolist())}
        given = {p for p, n in size.items() if n > large or (n > 8 and n * (n - 1) / 2 > dense * n)}
        assert {(r["sid_a"], r["sid_b"]) for r in out if r["sids"] is None} == {(i, j) for i in range(60) for j in range(i + 1, 60) if path[i] == path[j] and int(path[i]) not in given}
        for p, n in size.items():
            assert [x for r in out if r["path"] == p for x in r["sids"]] == (np.flatnonzero(path == p).tolist() if p in given else [])
            assert {r["over"] for r in out if r["path"] == p} <= {n > large}


def test_runs_grow_with_the_records():
    import numpy as np

    rng = np.random.default_rng(8)
    logs = np.log(np.minimum(0.5, 0.6 / np.arange(1, 600)))
    floor = np.log(nd.HEAVY)
    runs = [nd.runs_needed(logs, floor, n, 40.0, 32, 0.999) for n in (100, 20_000, 2_000_000, 200_000_000)]
    assert runs == sorted(runs) and runs[3] > runs[2] > runs[1] > runs[0] and nd.runs_needed(logs, floor, 20_000, 40.0, 32, 0.9) < runs[1]
    # one run of the walk itself, on a set inside another of 4/3 the size, whose words are drawn by the same frequencies
    p = np.exp(logs) / np.exp(logs).sum()
    met, n_tries, stop = 0, 3000, np.log(32 / 2_000_000)
    for _ in range(n_tries):
        words_log = logs[rng.choice(len(p), 30, p=p)]
        nodes = [0.0]
        for depth in range(nd.MAX_DEPTH):
            nodes = [a + w for a in nodes for w in words_log[rng.random(30) < 1 / 30]]
            if depth == nd.MAX_DEPTH - 1 and nodes or any(a <= stop for a in nodes):
                met += 1
                break
    assert (1 - met / n_tries) ** nd.runs_needed(logs, floor, 2_000_000, float(np.exp(logs).sum()), 32) <= 1.3 * (1 - nd.RECALL)


def test_production_runs_reach_the_target(spark, monkeypatch):
    monkeypatch.setattr(nd, "BUCKET", 32)
    rng = random.Random(9)
    texts = []
    for i in range(400):
        w = [f"w{int(600 ** rng.random())}" for _ in range(20)] + [f"r{i}x{j}" for j in range(10)]
        w = list(dict.fromkeys(w))
        texts += [" ".join(w), " ".join(w + [f"e{i}x{j}" for j in range(len(w) // 3)])]
    df = spark.createDataFrame([(f"k{i:04d}", t) for i, t in enumerate(texts)], "key string, text string")
    got = {(r.key_a, r.key_b) for r in nd.key_pairs(*nd.near_duplicates(df, "key", F.col("text"), 0.75)).collect()}
    want = {(f"k{i:04d}", f"k{i + 1:04d}") for i in range(0, 800, 2)}
    assert got >= want or len(want - got) <= 2


def test_a_third_copies_and_groups(spark):
    df = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 3 == 0, F.lit("same words in all of these copies")).otherwise(F.concat_ws(" ", *(F.concat(F.lit(f"q{i}x"), F.col("id")) for i in range(12)))).alias("text"))
    members, pairs = nd.near_duplicates(df, "key", F.col("text"))
    g = nd.groups(members, pairs).collect()
    assert len(g) == 300 and sum(r.n_links == 99 for r in g) == 100 and len({r.group_key for r in g}) == 201 and len({r.class_key for r in g}) == 201


def test_empty_tables(spark):
    df = spark.createDataFrame([], "key string, text string")
    members, pairs = nd.near_duplicates(df, "key", F.col("text"))
    assert members.count() == 0 and pairs.count() == 0
    m, f = lr.shared_stretches(df, "key", "text")
    assert m.count() == 0 and f.count() == 0
    m, p = cs.cross_split(spark.createDataFrame([], "id string, unit long, train boolean, text string"))
    assert cs.record_pairs(m, p).count() == 0


def test_heavy_tokens_are_counted_over_all(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("common u"), "id").alias("text"))
    heavy, logs, floor = nd.frequent_tokens(nd.word_sets(df, "key", F.col("text")), 500, 2.0)
    assert len(heavy) == 1 and logs[0] == 0.0 and floor < -6


@pytest.mark.parametrize("hot", [256, 2])
def test_cross_split_against_all_pairs(spark, hot, monkeypatch):
    monkeypatch.setattr(cs, "HOT", hot)
    texts = [*corpus(200, 2, 35, 3000, turn=True), "", None, "a", "a", "a b", "opening words of every unit " + " ".join(f"y{i}" for i in range(3000))]
    rows = [(f"v{i // 2:03d}", i % 2 + 1, i % 3 != 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[5]], "id string, unit long, train boolean, text string").withColumn("sid", F.lit("clash"))
    got = {((r.train_id, r.train_unit), (r.id, r.unit)) for r in cs.record_pairs(*cs.cross_split(df, 0.75)).collect()}
    want = {((a, i), (b, j)) for a, i, s, t in rows for b, j, u, v in rows if s and not u and a != b and words(t) and words(v) and jac(words(t), words(v)) >= 0.75}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 40


def splits(spark, texts):
    return spark.createDataFrame([(f"v{i:04d}", 1, i % 2 == 0, t) for i, t in enumerate(texts)], "id string, unit long, train boolean, text string")


def test_cross_split_finds_pairs_without_a_common_chunk(spark):
    rng = random.Random(6)
    texts = []
    for i in range(300):
        w = [f"w{i}x{j}" for j in range(7)]
        texts.append(" ".join(w))
        rng.shuffle(w)
        texts.append(" ".join([*w[:6], *([] if i % 2 else [w[6]])] if i % 3 else w + [f"v{i}", f"u{i}"]))
    got = {(r.train_id, r.id) for r in cs.record_pairs(*cs.cross_split(splits(spark, texts), 0.75)).collect()}
    assert got == {(f"v{i:04d}", f"v{i + 1:04d}") for i in range(0, 600, 2)}


@pytest.mark.parametrize("hot", [256, 0])
def test_cross_split_fraction_counts_all_shared_text(spark, hot, monkeypatch):
    monkeypatch.setattr(cs, "HOT", hot)
    texts = []
    for i in range(50):
        w = [f"w{i}x{j}" for j in range(60)]
        texts += [" ".join(w), " ".join([*w[:30], f"new{i}", *w[31:]])]
    texts += ["the same words in both", "the same words in both"]
    rows = cs.record_pairs(*cs.cross_split(splits(spark, texts), 0.75)).collect()
    assert len(rows) == 51 and max(r.fraction for r in rows) == 1.0
    changed = [r.fraction for r in rows if r.sim < 1]
    assert len(changed) == 50 and all(0.75 < f < 60 / 61 for f in changed) and sum(changed) / 50 > 0.9


def shares(a, b, n):
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in grams for i in range(len(b) - n + 1))


@pytest.mark.parametrize("hot", [32, 1])
def test_long_repeats_against_all_pairs(spark, hot, monkeypatch):
    monkeypatch.setattr(lr, "HOT", hot)
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10))) for _ in range(n))
    span, near, notice = text(90)[:430], text(90)[:399], text(60)[:300]
    docs = [text(120) + span + text(20), span, text(5) + span[10:420] + text(90), near + text(80), text(80) + near, "x" * 900, "y" + "x" * 450 + "z" + text(30), "“" + "ü—" * 250 + "”", text(3) + "ü—" * 220, "ü–" * 250, "", None]
    docs += [text(40) + notice + text(40) for _ in range(12)] + [docs[0]] * 2 + [text(5000)]
    rows = list(enumerate(docs))
    df = spark.createDataFrame([*rows, rows[1]], "doc int, text string").withColumn("pos", F.lit(1)).withColumn("cls", F.lit("c"))
    members, found = lr.shared_stretches(df, "doc", "text")
    got = {(r.key_a, r.key_b) for r in lr.document_pairs(members, found).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if a and b and shares(a, b, 400)}
    assert got == want and (0, 1) in want and (3, 4) not in want
    links = {r.key: (r.class_key, r.n_copies, r.n_links) for r in lr.linked(members, found).collect()}
    assert all(n == sum(k in p for p in want) for k, (_, _, n) in links.items()) and links[24][:2] == (0, 3)
    share = {r.key: r.shared_chars for r in lr.shared_share(df, "doc", "text").collect()}
    assert len(share) == len(rows)
    for k, t in rows:
        covered = set()
        for j, u in rows:
            if k != j and t and u:
                if t == u and len(t) >= 400:
                    covered.update(range(len(t)))
                else:
                    parts = {u[i : i + 400] for i in range(len(u) - 399)}
                    for i in range(len(t) - 399):
                        if t[i : i + 400] in parts:
                            covered.update(range(i, i + 400))
        assert share[k] == len(covered), k


@pytest.mark.parametrize("size", [1, 6, 12, 20, 24, 25, 30, 40, 47, 48, 60, 200])
def test_every_stretch_shares_a_name(size):
    """Three hundred stretches of exactly 400 characters in tokens of one length, between other text."""
    import pyarrow as pa

    rng = random.Random(size)
    token = lambda: "".join(rng.choice("abcdefgh0123") for _ in range(size)) + " "
    run = lambda n: "".join(token() for _ in range(n // (size + 1) + 2))
    missed = 0
    for _ in range(300):
        cut, span = rng.randrange(size + 1), run(500)
        span = span[cut : cut + 400]
        texts = [run(120)[rng.randrange(size + 1) :] + "x" + span + "x" + run(120), run(150) + "y" + span + "y" + run(90)]
        out = pa.Table.from_batches(lr._names(200)([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], ["cls", "text"])])).to_pylist()
        names = [{(r["name"], r["pos"]) for r in out if r["cls"] == c} for c in (1, 2)]
        missed += not {n for n, _ in names[0]} & {n for n, _ in names[1]}
    assert missed == 0


def test_runs_of_unequal_length_meet(spark):
    rng = random.Random(5)
    word = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    common, other = word(40)[:150], word(40)[:250]
    docs = ["-" * 500 + common + " q " + word(40), word(30) + "-" * 300 + common + " r " + word(40), word(20) + other + "-" * 400, other + "-" * 260 + " " + word(50), "=-" * 200 + common[:30] + word(40), word(9) + "=-" * 300 + common[:30] + " z"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, text string")
    got = {(r.key_a, r.key_b) for r in lr.document_pairs(*lr.shared_stretches(df, "doc", "text")).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if shares(docs[i], docs[j], 400)}
    assert got == want and (0, 1) in want and (2, 3) in want


def test_equal_spans_get_equal_names():
    rng = random.Random(4)
    t = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(200)) for _ in range(2)]
    b, at = batch.layout(t + [t[0]])
    total = batch.running(batch.values(t + [t[0]], b))
    sym, _, doc, _ = lr.recompress(b, at, total)
    assert (sym[doc == 0] == sym[doc == 2]).all() and not set(sym[doc == 0]) & set(sym[doc == 1])


def test_cross_split_one_edit_in_short_records(spark):
    """Records of 4 to 30 words with one word replaced, left out or added: all at the threshold or above are found."""
    rng = random.Random(21)
    rows, want = [], set()
    for k in range(700):
        n = 4 + k % 27
        a = [f"w{rng.randrange(5000)}" for _ in range(n)]
        b = list(a)
        i = rng.randrange(n)
        b[i : i + 1] = {0: [f"e{k}"], 1: [], 2: [a[i], f"e{k}"]}[k % 3]
        rows += [(f"a{k:03d}", 1, True, " ".join(a)), (f"b{k:03d}", 1, False, " ".join(b))]
        if jac(set(a), set(b)) >= 0.75:
            want.add((f"a{k:03d}", f"b{k:03d}"))
    df = spark.createDataFrame(rows, "id string, unit long, train boolean, text string").repartition(5)
    got = cs.record_pairs(*cs.cross_split(df, 0.75)).collect()
    assert {(r.train_id, r.id) for r in got} >= want and len(want) > 500
    assert all(0 <= r.fraction <= 1 for r in got)


def test_cross_split_of_one_text_in_many_batches(spark):
    """A text that a third of the records carry is one class on each side, whatever partitions it comes in."""
    rows = [(f"v{i:04d}", 1, i % 2 == 0, "one two three four five six seven eight" if i % 3 == 0 else f"text number {i} with words{i} of{i} its{i} own{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "id string, unit long, train boolean, text string").repartition(40)
    members, found = cs.cross_split(df, 0.75)
    assert found.count() == 1 and cs.record_pairs(members, found).count() == 100 * 100
