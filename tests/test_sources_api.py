"""Sources, sinks, the file stream and the answers on a small corpus."""

import json

import pytest

from pyspark.sql import functions as F

from syllaweave.api import Engine
from syllaweave.operators.catalog import content_hash
from syllaweave.sources import files as S
from syllaweave.streaming import incremental as I
from tests.test_operators import BLOCK

NAMES = ["Machine Learning", "Deep Learning", "Calculus", "Physics", "Programming in C", "Data Structures", "Software Engineering", "Statistics", "Databases", "Operating Systems"]


def corpus(spark, tmp_path):
    shared = {"title": "Regression", "text": "linear regression, ridge regression and gradient descent for prediction", "hours": 6}
    rows = []
    for i, n in enumerate([*NAMES, "Machine Learning"]):
        own = {"title": n, "text": " ".join(f"{n.split()[0].lower()}{k} topic{i}x{k}" for k in range(8)), "hours": 5}
        rows.append({
            "id": f"nmfx{i:06d}", "course_name": n, "course_key": n.lower().replace(" ", ""), "code": f"FX{i:04d}", "program": "B Tech", "semester": ["IV", "V", "I", "I", "I", "II", "III", "II", "II", "III", "IV"][i],
            "academic_year": "2024-25" if i == 10 else "2025-26", "prerequisites": "Quantum Field Theory" if n == "Software Engineering" else "", "objectives": f"To learn {n}.",
            "outcomes": [{"text": f"Explain the ideas of {n}", "k_levels": [2]}], "units": [own] + ([shared] if "Learning" in n else []), "source_files": ["2ND YEAR/COMPUTER/SEM/synthetic.pdf"], "n_source_files": 1, "source": "s",
        })
    p = tmp_path / "courses.jsonl"
    p.write_text("\n".join(json.dumps(r) for r in rows))
    return S.read_courses(spark, str(p))


def test_answers(spark, tmp_path):
    e = Engine(corpus(spark, tmp_path), tau=0.5, least_versions=1, least_families=1)
    assert e.health().first().courses == 11
    a, b = e.resolve(name="Deep Learning"), e.resolve(id="nmfx000000")
    c = e.compare_courses(a, b).first()
    assert [t.topic for t in c.common_topics] == ["Regression"] and c.percent == "50%" and 0 < c.confidence < 1 and not c.redundancy_warning
    assert [t.topic for t in c.unique_to_a] == ["Deep Learning"] and c.outcomes_a[0].level == "Understand" and c.prerequisites_a == []
    t = e.resolve(text="Alpha beta gamma delta.\n\nlinear regression, ridge regression and gradient descent for prediction", programme="COMP")
    assert t.first().programmes == ["COMP"] and e.compare_courses(t, b).first().common_topics[0].match == "Regression"
    assert e.find_overlaps(a, 3).first().course_name == "Machine Learning"
    for bad in ({}, {"id": "a", "name": "b"}):
        with pytest.raises(ValueError):
            e.resolve(**bad)
    with pytest.raises(ValueError, match="COMP"):
        e.detect_redundancy("NONE")
    assert [r.change for r in e.compare_programmes("COMP", "2024-25", "2025-26").filter("change = 'retained'").collect()] == ["retained"]
    assert e.compare_programmes("COMP").filter("change <> 'retained'").count() == 0
    assert {r.phrase for r in e.check_prerequisites("COMP").collect()} == {"Quantum Field Theory"}
    assert {r.phrase for r in e.check_prerequisites("COMP", rules=1).collect()} == {"Quantum Field Theory"}
    assert {r.course_name: r.status for r in e.check_status("COMP").collect()}["Calculus"] == "first or unknown semester"
    red = e.detect_redundancy("COMP").collect()
    assert len(red) == 1 and red[0].similarity == 1.0 and {red[0].course_a, red[0].course_b} == {"Machine Learning", "Deep Learning"}
    t = spark.createDataFrame([("Regression", "linear regression prediction", ["COMP"], True), ("Blockchain", "ledgers", ["COMP"], True)], "topic string, description string, programmes array<string>, verified boolean")
    assert {r.topic: r.covered for r in e.emerging_topics(t, "COMP").collect()} == {"Regression": True, "Blockchain": False}
    assert [r.bloom for r in e.map_outcomes(spark.createDataFrame([("Explain the layers",), ("Design a schema",), ("Hm",)], "text string")).collect()] == ["Understand", "Create", "Apply"]
    d = e.modernize(["nmfx000000", "nmfx000001"]).first()
    assert d.n_courses == 2 and any(u.sources == ["nmfx000000", "nmfx000001"] for u in d.units)
    jobs = spark.createDataFrame([("J1", "- Build and monitor vector search pipelines with gradient descent and Docker containers.\n"), ("J2", "- Deploy vector search pipelines, gradient descent and Docker containers in large teams.\n")], "job string, text string")
    draft = e.modernize(["nmfx000000", "nmfx000001"], jobs)
    d = draft.first()
    new = [u for u in d.units if u.sources == ["J1", "J2"]]
    assert len(new) == 1 and new[0].title == "Vector search pipelines" and d.lab_environment == ["Docker containers"] and any(u.title == "Regression" for u in d.units)
    p = e.passages(draft)
    assert p.filter("size(split(text, ' ')) > 100").count() == 0 and p.first().chunk_id == "C0000"
    q = spark.createDataFrame([(1, "Which pipelines does the industry require?")], "q int, question string")
    assert "pipelines" in e.ask(p, q).first().answer
    assert e.notice(draft, "Applied AI").first().doc_id == "curriculum-applied-ai-2025-26"
    for bad in (["a"], list("abcdefghijk")):
        with pytest.raises(ValueError):
            e.modernize(bad)
    assert e.list_courses(q="learning", limit=2).count() == 2
    assert len(e.answer(e.health())) == 1


def test_sinks(spark, tmp_path):
    c = corpus(spark, tmp_path)
    S.write_courses(c, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("year = '2024-25'").count() == 1
    S.write_csv(c.select("id", "source_files"), str(tmp_path / "csv"))
    assert S.read_labels(spark, str(tmp_path / "csv")).columns == ["id", "source_files"]
    S.write_parts(c.select("id"), str(tmp_path / "parts"), "id", 3)
    assert spark.read.json(str(tmp_path / "parts")).select("part").distinct().count() == 3
    assert S.remaining(c, c.limit(4), "id").count() == 7
    m = spark.createDataFrame([('{"a": {"b": [1, 2]}}',)], "j string")
    assert m.select(S.at_path(F.col("j"), "a.b.1")).first()[0] == "2"
    assert content_hash(c).count() == 11
    (tmp_path / "JD1.txt").write_text("Role: x")
    assert S.read_jobs(spark, str(tmp_path / "JD*.txt")).first().id == "JD1"
    (tmp_path / "t.json").write_text(json.dumps({"status": "s", "topics": [{"topic": "a", "verified": True}, {"topic": "b", "verified": False}]}, indent=1))
    assert S.read_topics(spark, str(tmp_path / "t.json")).count() == 1


def test_vector_cache(spark, tmp_path):
    asked = []

    def encode(df):
        asked.append(df.count())
        return df.select("sha1", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("vec"))

    t = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "t string")
    assert S.cached_vectors(spark, t, "t", str(tmp_path), "m", encode).count() == 2
    more = t.unionAll(spark.createDataFrame([("ccc",)], "t string"))
    assert S.cached_vectors(spark, more, "t", str(tmp_path), "m", encode).count() == 3 and asked == [2, 1]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    page = "AY 2025-26\n" + BLOCK
    for i in range(2):
        (src / f"{i}.json").write_text(json.dumps({"path": f"p{i}", "pages": [page]}) + "\n")
    for _ in range(2):  # a second run finds nothing new
        q = I.run(I.page_stream(spark, str(src), 1), str(tmp_path / "sink"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 1
