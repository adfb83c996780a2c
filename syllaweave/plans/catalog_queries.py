"""Queries of the catalogue operators over course versions, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from syllaweave.functions import course as C, rules
from syllaweave.functions.text import reduced
from syllaweave.operators import catalog as K
from syllaweave.sources.tables import table


def versions(spark: SparkSession, d: str) -> DataFrame:
    return K.versions(table(spark, d, "courses_small"))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return K.enrich(versions(spark, d))


def _sql_programme(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(trim({x})), '{p}') THEN '{n}'" for p, n in rules.PROGRAMMES) + " ELSE 'OTHER' END"


_REDUCED = "regexp_replace(replace(lower({0}), '&', 'and'), '[^a-z0-9]+', '', 'g')"
_NAME = f"coalesce(nullif({_REDUCED.format('course_key')}, ''), nullif({_REDUCED.format('course_name')}, ''))"
_CODE = "CASE WHEN regexp_matches(coalesce(code, ''), '[0-9]') THEN regexp_replace(upper(code), '[^A-Z0-9]+', '', 'g') END"
_Y = r"regexp_extract(academic_year, '(\d{4}|\d{2})\D+(\d{4}|\d{2})', %d)"
_AY = f"CASE WHEN (TRY_CAST(right({_Y % 1}, 2) AS INT) + 1) % 100 = TRY_CAST(right({_Y % 2}, 2) AS INT) THEN '20' || right({_Y % 1}, 2) || '-' || right({_Y % 2}, 2) END"
_SEM = r"""list_min(list_concat(
  list_transform(regexp_extract_all(upper(coalesce(semester, '')), '\b(VIII|VII|VI|IV|IX|V|III|II|I|X)\b', 1), lambda x: list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X'], x)::INT),
  list_transform(regexp_extract_all(coalesce(semester, ''), '\b([1-9]|10)\b', 1), lambda x: x::INT)))"""
CTE = f"""c AS (SELECT DISTINCT ON (id) * FROM courses_small WHERE id IS NOT NULL),
f AS (SELECT id, string_split(unnest(coalesce(source_files, [])), '/') AS p FROM c),
g AS (SELECT id, list(DISTINCT CASE WHEN len(p) > 2 THEN {_sql_programme('p[2]')} ELSE 'OTHER' END) AS pr,
             min(TRY_CAST(regexp_extract(p[1], '^(\\d)', 1) AS INT)) FILTER (WHERE TRY_CAST(regexp_extract(p[1], '^(\\d)', 1) AS INT) > 0) AS study_year FROM f GROUP BY id),
e AS (SELECT c.*, coalesce({_NAME}, c.id) AS family, coalesce({_AY}, '') AS ay, g.study_year,
             coalesce(list_contains(g.pr, 'COMMON'), false) OR regexp_matches(lower(coalesce(program, '')), '{rules.ALL_PROGRAMMES}') AS common,
             coalesce(list_contains(g.pr, 'OPEN'), false) AS open_elective,
             list_sort(list_filter(coalesce(g.pr, []), lambda x: x NOT IN ('COMMON', 'OPEN', 'OTHER'))) AS programmes,
             coalesce({_SEM}, 2 * g.study_year - 1) AS sem FROM c LEFT JOIN g ON c.id = g.id),
pl AS (SELECT DISTINCT unnest(programmes) AS programme FROM e),
bp AS (SELECT e.*, pl.programme FROM e, pl WHERE common UNION ALL BY NAME SELECT * FROM (SELECT *, unnest(programmes) AS programme FROM e WHERE NOT common)),
st AS (SELECT DISTINCT programme, sem, family FROM bp WHERE sem IS NOT NULL),
vw AS (SELECT * FROM bp QUALIFY row_number() OVER (PARTITION BY programme, family ORDER BY ay DESC, id DESC) = 1),
sn AS (SELECT * FROM (SELECT *, unnest(programmes) AS programme FROM e WHERE ay <> '') QUALIFY row_number() OVER (PARTITION BY programme, ay, family ORDER BY id DESC) = 1)
"""
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {CTE} SELECT id, coalesce({_REDUCED.format('course_name')}, '') AS name_key FROM c")
def cat_norm_name(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("id", F.coalesce(reduced(F.col("course_name")), F.lit("")).alias("name_key"))


@query(f"WITH {CTE} SELECT DISTINCT p[2] AS folder, {_sql_programme('p[2]')} AS programme FROM f WHERE len(p) > 2")
def cat_programme_of(spark: SparkSession, d: str) -> DataFrame:
    p = versions(spark, d).select(F.explode("source_files").alias("s")).select(F.split("s", "/").alias("p")).filter(F.size("p") > 2)
    return p.select(F.get("p", F.lit(1)).alias("folder")).distinct().withColumn("programme", C.programme_of(F.col("folder")))


@query(f"WITH {CTE} SELECT id, {_SEM} AS sem FROM c")
def cat_sem_min(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("id", C.sem_min(F.col("semester")).alias("sem"))


@query(f"WITH {CTE} SELECT id, {_AY} AS ay, {_CODE} AS code_key FROM c")
def cat_year_and_code(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("id", C.year_key(F.col("academic_year")).alias("ay"), C.code_key(F.col("code")).alias("code_key"))


@query(f"WITH {CTE} SELECT id, family, common, open_elective, array_to_string(programmes, ';') AS programmes, study_year, sem, ay FROM e")
def cat_enrich(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d).select("id", "family", "common", "open_elective", F.array_join("programmes", ";").alias("programmes"), "study_year", "sem", "ay")


@query(f"""WITH RECURSIVE {CTE}, v AS (SELECT id, 'n:' || {_NAME} AS a, 'c:' || {_CODE} AS b FROM c),
ed AS (SELECT DISTINCT a, b FROM v WHERE a IS NOT NULL AND b IS NOT NULL), dd AS (SELECT a AS x, b AS y FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT x, x AS y FROM dd UNION SELECT reach.x, dd.y FROM reach JOIN dd ON reach.y = dd.x),
root AS (SELECT x, min(y) AS r FROM reach GROUP BY x), own AS (SELECT v.id, coalesce(root.r, a, b, 'i:' || id) AS r FROM v LEFT JOIN root ON coalesce(a, b) = root.x)
SELECT id, 'f' || substr(min(id) OVER (PARTITION BY r), 3) AS family FROM own""")
def cat_families(spark: SparkSession, d: str) -> DataFrame:
    return K.families(versions(spark, d))


@query(f"WITH {CTE} SELECT family, id, ay, n_source_files FROM e QUALIFY row_number() OVER (PARTITION BY family ORDER BY ay DESC, n_source_files DESC NULLS LAST, id DESC) = 1")
def cat_representatives(spark: SparkSession, d: str) -> DataFrame:
    return K.representatives(enriched(spark, d).select("family", "id", "ay", "n_source_files"))


@query(f"WITH {CTE} SELECT programme, family, id, course_name, sem, ay FROM vw")
def cat_programme_view(spark: SparkSession, d: str) -> DataFrame:
    return K.programme_view(enriched(spark, d).select("family", "id", "course_name", "sem", "ay", "programmes", "common")).select("programme", "family", "id", "course_name", "sem", "ay")


@query(f"WITH {CTE} SELECT programme, sem, count(*) AS n_families FROM st GROUP BY ALL")
def cat_structure(spark: SparkSession, d: str) -> DataFrame:
    return K.structure(enriched(spark, d)).groupBy("programme", "sem").agg(F.count("*").alias("n_families"))


@query(f"WITH {CTE} SELECT programme, count(*) AS n FROM (SELECT unnest(programmes) AS programme FROM e) GROUP BY 1")
def cat_versions(spark: SparkSession, d: str) -> DataFrame:
    return K.version_counts(enriched(spark, d))


@query(f"WITH {CTE} SELECT programme, ay, family, id FROM sn")
def cat_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return K.snapshot(enriched(spark, d).select("id", "ay", "family", "programmes")).select("programme", "ay", "family", "id")


@query(f"""WITH {CTE}, s AS (SELECT programme, ay, count(*) AS n FROM sn GROUP BY ALL HAVING count(*) >= 10),
y AS (SELECT ay, lead(ay) OVER (ORDER BY ay) AS next_ay FROM (SELECT DISTINCT ay FROM e WHERE ay <> ''))
SELECT a.programme, a.ay, y.next_ay, a.n, b.n AS next_n FROM s a JOIN y ON a.ay = y.ay JOIN s b ON a.programme = b.programme AND b.ay = y.next_ay""")
def cat_year_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.year_pairs(enriched(spark, d))


_EDA_YEARS = [f"20{y:02d}-{y + 1:02d}" for y in range(18, 26)]


@query(f"WITH {CTE}, x AS (SELECT unnest(programmes) AS programme, ay FROM e) SELECT programme, {', '.join(f'''count(*) FILTER (WHERE ay = '{y}') AS y{y[:4]}''' for y in _EDA_YEARS)}, count(*) AS n FROM x GROUP BY 1")
def cat_eda_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = enriched(spark, d).select(F.explode("programmes").alias("programme"), "ay")
    return x.groupBy("programme").agg(*(F.count_if(F.col("ay") == y).alias(f"y{y[:4]}") for y in _EDA_YEARS), F.count("*").alias("n"))


@query(f"""WITH {CTE}, x AS (SELECT coalesce(nullif(ay, ''), 'unknown') AS ay, len(regexp_extract_all(lower(concat_ws(' ', coalesce(objectives, ''), array_to_string(list_transform(outcomes, lambda o: o.text), ' '), array_to_string(list_transform(units, lambda u: u.text), ' '))), '[a-z0-9]+')) AS n FROM e)
SELECT ay, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(avg(n), 6) AS mean FROM x GROUP BY 1""")
def cat_percentiles(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all(F.lower(C.course_text()), F.lit("[a-z0-9]+"), F.lit(0)))
    x = enriched(spark, d).select(F.coalesce(F.nullif("ay", F.lit("")), F.lit("unknown")).alias("ay"), n.alias("n"))
    return x.groupBy("ay").agg(*(F.round(F.percentile("n", p), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)), F.round(F.avg("n"), 6).alias("mean"))


@query(f"WITH {CTE} SELECT id, course_name, ay FROM e WHERE contains(lower(course_name), 'physics') ORDER BY ay DESC, id DESC LIMIT 50")
def cat_search(spark: SparkSession, d: str) -> DataFrame:
    return K.search(enriched(spark, d), "physics").select("id", "course_name", "ay")


@query(f"""WITH {CTE}, h AS (SELECT id, source, coalesce(objectives, chr(30)) AS o FROM c)
SELECT arg_min(id, source || chr(31) || id) AS kept_id, count(*) AS n_blocks, count(DISTINCT source) AS n_sources FROM h GROUP BY o HAVING count(*) > 1""")
def cat_dedupe_hash(spark: SparkSession, d: str) -> DataFrame:
    return K.content_hash(versions(spark, d), ("objectives",)).filter("n_blocks > 1").select("kept_id", "n_blocks", F.size("sources").cast("bigint").alias("n_sources"))


@query(f"""WITH {CTE} SELECT count(*) AS courses, count(DISTINCT course_key) AS names, count_if(coalesce(prerequisites, '') <> '')::BIGINT AS with_prerequisites, count_if(coalesce(objectives, '') <> '')::BIGINT AS with_objectives,
count_if(len(outcomes) > 0)::BIGINT AS with_outcomes, sum(coalesce(len(outcomes), 0))::BIGINT AS outcomes_total, sum(len(list_filter(outcomes, lambda o: len(o.k_levels) > 0)))::BIGINT AS outcomes_with_level, sum(coalesce(len(units), 0))::BIGINT AS units_total,
sum(len(list_filter(units, lambda u: coalesce(u.title, '') <> '')))::BIGINT AS units_with_title, sum(len(list_filter(units, lambda u: u.hours IS NOT NULL)))::BIGINT AS units_with_hours, count_if(coalesce(code, '') <> '')::BIGINT AS with_code, count_if(credits IS NOT NULL)::BIGINT AS with_credits FROM c""")
def cat_parse_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.statistics(versions(spark, d))


@query(f"WITH {CTE}, s AS (SELECT DISTINCT family, ('0x' || substr(md5('42:' || family), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS h FROM e) SELECT CASE WHEN h < 0.6 THEN 'train' WHEN h < 0.8 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM s GROUP BY 1")
def cat_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.split_by_rank(enriched(spark, d)).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {CTE} SELECT id, course_name, ay, coalesce(credits, 0) AS credits FROM e QUALIFY row_number() OVER (PARTITION BY family ORDER BY ay DESC, n_source_files DESC NULLS LAST, id DESC) = 1 AND list_contains(programmes, 'COMP')")
def cat_list_programme(spark: SparkSession, d: str) -> DataFrame:
    return K.representatives(enriched(spark, d)).filter(F.array_contains("programmes", "COMP")).select("id", "course_name", "ay", F.coalesce("credits", F.lit(0)).alias("credits"))
