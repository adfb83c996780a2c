"""Packed values against the published examples and an independent reader of characters."""

import re

from hypothesis import given, settings, strategies as st

from syllaweave.operators.packed import name_pattern, split_packed

NAMES = ["Graph Theory and Practice", "Ethics, Law and Society"]
CASES = {
    "Theory I, II": ["theoryi", "theoryii"],
    "Engineering Mathematics - I,II and III; Speech": ["engineeringmathematicsi", "engineeringmathematicsii", "engineeringmathematicsiii", "speech"],
    '"Ethics, Law and Society" and Physics': ["ethicslawandsociety", "physics"],
    '"""Analog"" Devices"; B': ["analogdevices", "b"],
    "'Ethics, Law & Society', Physics (BTCE102, BTAB203 & X)": ["ethicslawandsociety", "physics"],
    "Graph  THEORY & practice & Physics": ["graphtheoryandpractice", "physics"],
    "1) Signal Devices 2) Physics I, 3) Chemistry": ["signaldevices", "physicsi", "chemistry"],
    "• A1\n• B2": ["a1", "b2"],
    "- Physics - 1\n- Chemistry": ["physics1", "chemistry"],
    "Basics of Physics and/or Chemistry as well as Biology": ["basicsofphysics", "chemistry", "biology"],
    "A, ; A,": ["a", "a"],
    'say "x': ["sayx"],
    "Nil": [],
    " N/A ": [],
    "": [],
    None: [],
}


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "id int, p string, value string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    out = {}
    for r in split_packed(df, "p", "id", names).orderBy("id", "pos").collect():
        out.setdefault(r.id, []).append((r.pos, r.value_key))
    return [out.get(i, []) for i in range(len(texts))]


def test_examples(spark):
    got = run(spark, list(CASES))
    for text, want, rows in zip(CASES, CASES.values(), got):
        assert [k for _, k in rows] == want, text
        assert [p for p, _ in rows] == list(range(1, len(want) + 1)), text


def test_repeated_rows_empty_table_and_long_text(spark):
    df = spark.createDataFrame([("a", "x, y")] * 3 + [(None, "z")], "id string, p string")
    assert sorted((r.id or "", r.value_key) for r in split_packed(df, "p", "id").collect()) == [("", "z"), ("a", "x"), ("a", "y")]
    assert split_packed(df.limit(0), "p", "id").count() == 0
    long = spark.createDataFrame([("a", ", ".join(f"v{i}" for i in range(3000)))], "id string, p string")
    assert split_packed(long, "p", "id").count() == 3000


def by_characters(text):
    """A plain reader for texts of words, commas, ``;``, double quotes and ``and``."""
    values, cur, i = [], "", 0
    while i < len(text):
        c = text[i]
        if c == '"':
            end, lit = i + 1, ""
            while end < len(text):
                if text[end] == '"' and text[end + 1 : end + 2] == '"':
                    lit, end = lit + '"', end + 2
                elif text[end] == '"':
                    break
                else:
                    lit, end = lit + text[end], end + 1
            values += [cur, lit]
            cur, i = "", end + 1
        elif c in ",;":
            values.append(cur)
            cur, i = "", i + 1
        else:
            cur, i = cur + c, i + 1
    return [*values, cur]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["alpha", "beta gamma", '"delta, epsilon"', '"""zeta"" eta"', "Theta and", "iota"]), min_size=1, max_size=6), min_size=20, max_size=40))
def test_against_characters(spark, rows):
    texts = ["; ".join(r).replace("and;", "and") for r in rows]
    want = []
    for t in texts:
        keys = []
        for v in by_characters(t):
            for w in [v] if "," in v or '"' in v else re.split(r"\band\b", v):
                if k := re.sub("[^a-z0-9]", "", w.lower()):
                    keys.append(k)
        want.append(keys)
    assert [[k for _, k in r] for r in run(spark, texts)] == want


def test_names_without_joining_words_need_no_pattern():
    assert name_pattern(["Physics"]) is None
    assert name_pattern(NAMES) is not None
