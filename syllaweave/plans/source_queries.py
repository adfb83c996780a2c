"""Queries of sources and sinks: tables written to the shared folder in a format, read back, and compared with the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from syllaweave.operators.lexical import counts, hashed_vectors
from syllaweave.plans.catalog_queries import CTE, versions
from syllaweave.session import stage_folder
from syllaweave.sources import files as S
from syllaweave.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _at(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {CTE} SELECT id, course_name, credits, len(units) AS n_units, array_to_string(list_transform(outcomes, lambda o: len(o.k_levels)::VARCHAR), ';') AS levels, n_source_files FROM c")
def src_courses(spark: SparkSession, d: str) -> DataFrame:
    """Course records as JSON lines by the declared schema."""
    path = _at(spark, "courses")
    versions(spark, d).write.json(path)
    c = S.read_courses(spark, path)
    return c.select("id", "course_name", "credits", F.size("units").cast("bigint").alias("n_units"), F.array_join(F.transform("outcomes", lambda o: F.size(o["k_levels"]).cast("string")), ";").alias("levels"), "n_source_files")


@query(f"WITH {CTE} SELECT id, coalesce(academic_year, 'unknown') AS year FROM c WHERE academic_year = '2024-25'")
def src_year_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each academic year; the query reads one of them."""
    path = _at(spark, "years")
    S.write_courses(versions(spark, d), path)
    return spark.read.parquet(path).filter("year = '2024-25'").select("id", F.col("year").cast("string").alias("year"))


@query("WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS pages FROM documents) SELECT count(*) AS files, sum(len(pages))::BIGINT AS pages, sum(length(array_to_string(pages, '')))::BIGINT AS characters, 0::BIGINT AS unreadable FROM d")
def src_page_cache(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.split(F.coalesce("text", F.lit("")), "\n").alias("pages"))
    return S.write_pages(p, _at(spark, "pages"))


@query("SELECT item, nullif(nullif(kind, ''), 'None') AS kind, nullif(nullif(pass1, ''), 'None') AS pass1, nullif(nullif(consensus, ''), 'None') AS consensus FROM jdskills_llm")
def src_labels(spark: SparkSession, d: str) -> DataFrame:
    """A label file as CSV: the empty string and None are NULL."""
    path = _at(spark, "labels")
    S.write_csv(table(spark, d, "jdskills_llm"), path)
    return S.read_labels(spark, path).select("item", "kind", "pass1", "consensus")


@query(f"WITH {CTE} SELECT id, array_to_string(source_files, '; ') AS source_files, n_source_files::VARCHAR AS n FROM c")
def src_list_cells(spark: SparkSession, d: str) -> DataFrame:
    """Lists as joined cells of a CSV file."""
    path = _at(spark, "cells")
    S.write_csv(versions(spark, d).select("id", "source_files", "n_source_files"), path)
    return S.read_labels(spark, path).select("id", "source_files", F.col("n_source_files").alias("n"))


@query("SELECT topic, array_to_string(programmes, ';') AS programmes, source FROM emerging_topics WHERE verified")
def src_topics(spark: SparkSession, d: str) -> DataFrame:
    """The reference list of topics as one JSON document; verified rows only."""
    path = _at(spark, "topics")
    t = table(spark, d, "emerging_topics").agg(F.to_json(F.struct(F.lit("reviewed").alias("status"), F.collect_list(F.struct("topic", "description", "programmes", "source", "verified", "note")).alias("topics"))).alias("value"))  # forty rows
    t.coalesce(1).write.text(path)
    return S.read_topics(spark, path).select("topic", F.array_join("programmes", ";").alias("programmes"), "source")


@query("WITH d AS (SELECT DISTINCT doc_id FROM documents), n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM d) SELECT ((rn - 1) // ((n + 6) // 7))::BIGINT AS part, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM n GROUP BY 1")
def src_parts(spark: SparkSession, d: str) -> DataFrame:
    """Items in seven folders of equal size in the order of their keys."""
    path = _at(spark, "parts")
    S.write_parts(table(spark, d, "documents").select("doc_id").distinct(), path, "doc_id", 7)
    return spark.read.json(path).groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("SELECT count(DISTINCT doc_id) AS done, count(DISTINCT doc_id) FILTER (WHERE doc_id % 3 <> 0) AS added FROM documents")
def src_resume(spark: SparkSession, d: str) -> DataFrame:
    """A job that is started again only does and adds what is left."""
    path = _at(spark, "resumed")
    x = table(spark, d, "documents").select("doc_id").distinct()
    first = S.append_results(x.filter("doc_id % 3 = 0"), path, "doc_id")
    left = S.remaining(x, first, "doc_id")
    n = left.count()
    return S.append_results(x, path, "doc_id").agg(F.count("*").alias("done"), F.lit(n).cast("bigint").alias("added"))


@query("SELECT count(DISTINCT text) AS vectors, 1.0::DOUBLE AS length FROM documents WHERE text IS NOT NULL AND regexp_matches(lower(text), '[a-z0-9]{2,}')")
def src_vector_cache(spark: SparkSession, d: str) -> DataFrame:
    """Hashed vectors of document texts over a cache that holds a part of them already: each text once, unit length."""
    path = _at(spark, "vectors")

    def encode(df: DataFrame) -> DataFrame:
        from syllaweave.operators.lexical import dense

        return dense(hashed_vectors(counts(df, ["sha1"], F.col("text"), stop=False), "sha1"), "sha1", 256).select("sha1", F.col("vec").cast("array<float>").alias("vec"))

    docs = table(spark, d, "documents").select("doc_id", "text").filter(F.lower("text").rlike("[a-z0-9]{2,}"))
    S.cached_vectors(spark, docs.filter("doc_id % 2 = 0"), "text", path, "hashed", encode).count()
    v = S.cached_vectors(spark, docs, "text", path, "hashed", encode)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return v.agg(F.count_distinct("sha1").alias("vectors"), F.round(F.avg(norm), 5).alias("length"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT min(doc_id) FROM documents)::VARCHAR AS first_doc")
def src_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics as a JSON document, read by dotted paths."""
    path = _at(spark, "metrics")
    m = table(spark, d, "documents").agg(F.struct(F.count("*").alias("documents"), F.array(F.min("doc_id"), F.max("doc_id")).alias("range")).alias("corpus"))
    S.write_metrics(m, path)
    return spark.read.text(path).select(S.at_path(F.col("value"), "corpus.documents").cast("bigint").alias("documents"), S.at_path(F.col("value"), "corpus.range.0").alias("first_doc"))


@query("WITH n AS (SELECT doc_kind, count(*) AS n, avg(length(coalesce(text, ''))) AS m FROM documents GROUP BY 1) SELECT doc_kind, doc_kind || ': ' || format('{:,}', n) || ' texts of ' || format('{:,.1f}', round(m, 1)) || ' characters, {{unknown:0}}' AS line FROM n")
def src_templates(spark: SparkSession, d: str) -> DataFrame:
    """Report lines with placeholders, filled from metrics."""
    n = table(spark, d, "documents").groupBy("doc_kind").agg(F.count("*").cast("double").alias("n"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("m"))
    m = n.unpivot("doc_kind", ["n", "m"], "what", "value").select(F.concat_ws(" ", "doc_kind", "what").alias("name"), "value")
    t = n.select("doc_kind", F.concat("doc_kind", F.lit(": {{"), "doc_kind", F.lit(" n:0}} texts of {{"), "doc_kind", F.lit(" m:1}} characters, {{unknown:0}}")).alias("line"))
    return S.filled(t, "line", m)


@query(f"WITH {CTE} SELECT id, md5(coalesce(array_to_string(list_transform(units, lambda u: u.text), '|'), '')) AS hash FROM c")
def src_audit(spark: SparkSession, d: str) -> DataFrame:
    """Raw blocks go to an audit folder and not to the published table."""
    path = _at(spark, "audit")
    r = versions(spark, d).select("id", "course_name", F.coalesce(F.array_join("units.text", "|"), F.lit("")).alias("raw_block"))
    public = S.write_audit(r, path, ["raw_block"])
    assert public.columns == ["id", "course_name"]
    return spark.read.parquet(path).select("id", F.md5("raw_block").alias("hash"))
