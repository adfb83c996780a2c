"""Queries of themes, topics, drafts, summaries, samples and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from syllaweave.functions import course as C
from syllaweave.operators import assemble as A, catalog as K, parse as P
from syllaweave.plans import schedule_queries as S
from syllaweave.plans.catalog_queries import CTE, enriched, versions
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


_GENERIC = ", ".join(f"'{w}'" for w in A.GENERIC_SKILL_WORDS.split())
_LEAD = f"(?i)^(?:{A.DETERMINERS[5:]}|{A.LEAD_VERB[5:]})+"
_PHRASES = f"list_filter(list_transform(regexp_split_to_array(r, '{A.PHRASE_BREAK}'), lambda p: regexp_replace(regexp_replace(p, '^[^A-Za-z]+|[\\s\\xA0]+$', '', 'g'), '{_LEAD}', '')), lambda p: length(p) > 2 AND len(list_filter(regexp_extract_all(lower(p), '[a-z][a-z+\\-]*'), lambda w: w NOT IN ({_GENERIC}))) > 0)"
JOBS = r"""jl AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')), '^\s*(?:[-*•]|\d+[.)])\s*', '')) AS x FROM documents WHERE doc_kind = 'job_description'),
jk AS (SELECT * FROM jl WHERE x <> '' AND NOT regexp_matches(x, '(?i)^(?:role|responsibilities|requirements|synthetic sample|about|location|salary)\b') AND NOT ends_with(x, ':')),
js AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(x, '([.;])\s+', '\1' || chr(31), 'g'), chr(31)))) AS r FROM jk), jr AS (SELECT * FROM js WHERE len(list_filter(regexp_split_to_array(r, '\s+'), lambda w: w <> '')) >= 5)""" + f", jp AS (SELECT doc_id, unnest({_PHRASES}) AS phrase FROM jr)"


@query(f"WITH {JOBS} SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS n_jobs FROM jp GROUP BY 1")
def mod_skill_phrases(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").filter("doc_kind = 'job_description'").select("doc_id", F.explode(C.requirements(F.col("text"))).alias("r"))
    return j.select("doc_id", F.explode(A.skill_phrases(F.col("r"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_jobs"))


@query()
def mod_themes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one label clustered by average linkage."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("label"), "vec_id", "embedding")
    return A.themes(v, "label", "vec_id", "embedding", 0.2).groupBy("label", "cluster").agg(F.first("medoid").alias("medoid"), F.count("*").alias("n"))


@query()
def tpc_kmeans(spark: SparkSession, d: str) -> DataFrame:
    t, _ = A.topic_model(table(spark, d, "embeddings"), "vec_id", "embedding", k=10, starts=2)
    return t.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("coherence"))


@query(f"""WITH {CTE}, s AS (SELECT programme, lecture_hrs, practical_hrs, tutorial_hrs, credits, count(*) AS n FROM bp WHERE credits IS NOT NULL GROUP BY ALL)
SELECT programme, lecture_hrs, practical_hrs, tutorial_hrs, credits FROM s QUALIFY row_number() OVER (PARTITION BY programme ORDER BY n DESC, lecture_hrs NULLS FIRST, practical_hrs NULLS FIRST, tutorial_hrs NULLS FIRST, credits) = 1""")
def mod_teaching_scheme(spark: SparkSession, d: str) -> DataFrame:
    return A.teaching_scheme(K.by_programme(enriched(spark, d)), ["programme"])


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    """A draft for each programme from the units that two or more of its courses share word for word."""
    view = K.programme_view(enriched(spark, d))
    u = view.select("programme", "id", F.explode("units").alias("u")).select("programme", "id", "u.*").filter("text <> ''")
    shared = u.groupBy("programme", "text").agg(F.min("title").alias("title"), F.max("hours").alias("hours"), F.array_sort(F.collect_set("id")).alias("sources")).filter(F.size("sources") >= 2)
    return A.draft(view, shared)


_DRAFT = f"""{CTE}, du AS (SELECT programme, id, unnest(units) AS u FROM vw), dg AS (SELECT programme, u.text AS text, min(u.title) AS title, max(u.hours) AS hours, list_sort(list(DISTINCT id)) AS sources FROM du WHERE u.text <> '' GROUP BY ALL HAVING count(DISTINCT id) >= 2),
dh AS (SELECT programme, count(*) AS n_units, sum(coalesce(hours, 6))::BIGINT AS total_hours FROM dg GROUP BY 1), dou AS (SELECT programme, count(DISTINCT text) AS n FROM (SELECT programme, unnest(outcomes).text AS text FROM vw) WHERE text IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {_DRAFT}, dt AS (SELECT programme, regexp_replace(coalesce(prerequisites, ''), '\\(([^)]*\\d[^)]*)\\)', ' ', 'g') AS t FROM vw), dp AS (SELECT programme, count(DISTINCT p) AS n FROM (SELECT programme, unnest({S._SPLIT1}) AS p FROM dt) GROUP BY 1)
SELECT programme, count(*) AS n_courses, max(ay) AS academic_year, any_value(coalesce(n_units, 0)) AS n_units, any_value(coalesce(total_hours, 0)) AS total_hours, any_value(least(4, coalesce(dou.n, 0))) AS n_outcomes, any_value(coalesce(dp.n, 0)) AS n_prerequisites, true AS traceable FROM vw LEFT JOIN dh USING (programme) LEFT JOIN dou USING (programme) LEFT JOIN dp USING (programme) GROUP BY 1""")
def mod_build(spark: SparkSession, d: str) -> DataFrame:
    x = _drafts(spark, d)
    return x.select("programme", "n_courses", "academic_year", F.size(F.coalesce("units", F.array())).alias("n_units"), F.coalesce("total_hours", F.lit(0)).alias("total_hours"), F.size(F.coalesce("outcomes", F.array())).alias("n_outcomes"), F.size(F.coalesce("prerequisites", F.array())).alias("n_prerequisites"), A.traceable().alias("traceable"))


@query()
def mod_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _drafts(spark, d).select("programme", A.markdown(F.concat(F.lit("Draft for "), "programme")).alias("markdown"))


@query(f"WITH {CTE} SELECT id, array_to_string((list_filter(list_transform(units, lambda u: u.title), lambda t: coalesce(t, '') <> ''))[1:3], '; ') AS lead, array_to_string((list_transform(outcomes, lambda o: o.text))[1:2], ' ') AS outcomes FROM c")
def sum_extractive(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("id", A.lead_summary().alias("lead"), A.outcome_summary().alias("outcomes"))


_WS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


@query(f"""WITH {CTE}, s AS (SELECT id, {_WS.format("array_to_string((list_filter(list_transform(units, lambda u: u.title), lambda t: coalesce(t, '') <> ''))[1:3], '; ')")} AS a, {_WS.format("objectives")} AS b FROM c),
h AS (SELECT id, a, b, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS hits FROM s)
SELECT id, round(coalesce(hits, 0) / greatest(len(a), 1), 6) AS precision, round(coalesce(hits, 0) / greatest(len(b), 1), 6) AS recall FROM h""")
def sum_rouge(spark: SparkSession, d: str) -> DataFrame:
    x = versions(spark, d).select("id", A.lead_summary().alias("s"), "objectives")
    r = A.rouge_n(F.col("objectives"), F.col("s"), 1)
    return x.select("id", F.round(r["precision"], 6).alias("precision"), F.round(r["recall"], 6).alias("recall"))


@query()
def sum_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    x = versions(spark, d).select("id", A.lead_summary().alias("s"), "objectives")
    return x.select("id", F.round(A.rouge_l("objectives", "s"), 6).alias("rouge_l"))


@query(f"WITH {CTE} SELECT id, round(len(list_filter(list_distinct(list_filter({_WS.format('course_name')}, lambda w: length(w) >= 4)), lambda w: NOT list_contains({_WS.format('objectives')}, w))) / greatest(len(list_distinct(list_filter({_WS.format('course_name')}, lambda w: length(w) >= 4))), 1), 6) AS rate FROM c")
def sum_unsupported(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("id", F.round(A.unsupported_rate(F.col("course_name"), F.col("objectives")), 6).alias("rate"))


@query(f"WITH {CTE} SELECT ay, id FROM e QUALIFY row_number() OVER (PARTITION BY ay ORDER BY md5('42:' || id), id) <= 5")
def smp_stratified(spark: SparkSession, d: str) -> DataFrame:
    return A.stratified(enriched(spark, d).select("ay", "id"), "ay", "id", 5)


_PW = r"list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda w: w <> '')"
_SH = "('0x' || substr(md5('42:' || (i - 1) || ':' || w), {0}, 6))::BIGINT / 16777216.0::DOUBLE"
_SW = f"substr(w, 1, k - 1) || substr(w, k + 1, 1) || substr(w, k, 1) || substr(w, k + 2)"
_WS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query(f"""WITH d AS (SELECT DISTINCT doc_id, text, {_PW} AS ws FROM documents), t AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d), h AS (SELECT *, {_SH.format(1)} AS a, (floor({_SH.format(7)} * (length(w) - 3)) + 2)::INT AS k FROM t),
ty AS (SELECT doc_id, string_agg(CASE WHEN length(w) > 3 AND a < 0.05 THEN {_SW} ELSE w END, ' ' ORDER BY i) AS p FROM h GROUP BY 1), dr AS (SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE a >= 0.15), min(w) FILTER (WHERE i = 1)) AS p FROM h GROUP BY 1),
al AS (SELECT 'typos' AS kind, d.doc_id, text, coalesce(p, '') AS p FROM d LEFT JOIN ty USING (doc_id) UNION ALL SELECT 'drop', d.doc_id, text, coalesce(p, '') FROM d LEFT JOIN dr USING (doc_id) UNION ALL SELECT 'truncate', doc_id, text, array_to_string(ws[1:greatest(1, floor(len(ws) * 0.5)::INT)], ' ') FROM d)
SELECT kind, count(*) AS n, round(avg(len(list_intersect({_WS.format("coalesce(text, '')")}, {_WS.format('p')})) / greatest(1, len(list_distinct(list_concat({_WS.format("coalesce(text, '')")}, {_WS.format('p')}))))), 6) AS overlap FROM al GROUP BY 1""")
def rob_perturbed(spark: SparkSession, d: str) -> DataFrame:
    """Mean word overlap of documents with their changed copies, for each kind of change."""
    from syllaweave.functions.text import jaccard, words_of

    x, out = table(spark, d, "documents").select("doc_id", "text").distinct(), None
    for kind, rate in (("typos", 0.05), ("drop", 0.15), ("truncate", 0.5)):
        y = x.withColumn("p", A.perturb(F.col("text"), kind, rate, 42))
        j = y.select(F.lit(kind).alias("kind"), jaccard(F.array_distinct(words_of(F.col("text"))), F.array_distinct(words_of(F.col("p")))).alias("j"))
        g = j.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("j"), 6).alias("overlap"))
        out = g if out is None else out.unionByName(g)
    return out


_FLAT = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


@query(f"""WITH {CTE} SELECT id, regexp_replace(replace(lower(coalesce(nullif(trim(course_name), ''), 'Course')), '&', 'and'), '[^a-z0-9]+', '', 'g') AS course_key, len(list_filter(units, lambda u: {_FLAT.format('u.text')} <> '')) AS n_units, coalesce(list_sum(list_transform(units, lambda u: length({_FLAT.format('u.text')}))), 0)::BIGINT AS n_chars,
length({_FLAT.format('objectives')}) AS n_objectives, {_FLAT.format('prerequisites')} AS prerequisites, len(list_filter(coalesce(outcomes, []), lambda o: len(regexp_split_to_array({_FLAT.format('o.text')}, ' ')) >= 3)) AS n_outcomes FROM c WHERE len(units) > 0""")
def prs_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Course versions with units written as booklet pages and parsed again: a round trip over the whole table."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    numbered = lambda c, mark: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x, i: F.concat((i + 1).cast("string"), F.lit(mark), x["text"])), "\n")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Program: "), F.coalesce(F.nullif("program", F.lit("")), F.lit("B Tech"))), F.lit("Semester : V"), F.concat(F.lit("Course : "), F.coalesce(F.nullif(F.trim("course_name"), F.lit("")), F.lit("Course"))),
        F.lit("Module Code: 702CE0C099"), F.concat(F.lit("Pre-requisite: "), flat(F.col("prerequisites"))), F.concat(F.lit("Objectives: "), F.coalesce("objectives", F.lit(""))),
        F.lit("Course Outcomes:"), numbered(F.col("outcomes"), ". "), F.lit("Detailed Syllabus:"), numbered(F.col("units"), "\n"), F.lit("Total"),
    )
    pages = versions(spark, d).filter(F.size("units") > 0).select(F.col("id").alias("path"), F.array(lines).alias("pages"))
    r = P.parse_pages(pages)
    chars = F.aggregate(F.transform("units", lambda u: F.length(u["text"]).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return r.select(F.col("source").alias("id"), "course_key", F.size("units").cast("bigint").alias("n_units"), chars.alias("n_chars"), F.length("objectives").cast("bigint").alias("n_objectives"), "prerequisites", F.size("outcomes").cast("bigint").alias("n_outcomes"))


_SQ = "length(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"


@query(f"""WITH {CTE}, s AS (SELECT id AS key, course_name AS h, objectives AS t FROM c UNION ALL SELECT id, u.title, u.text FROM (SELECT id, unnest(units) AS u FROM c))
SELECT key, count(*) FILTER (WHERE {_SQ.format('h')} > 0 OR {_SQ.format('t')} > 0) AS sections, coalesce(sum({_SQ.format('t')}), 0)::BIGINT AS chars FROM s GROUP BY 1 HAVING sections > 0""")
def prs_html(spark: SparkSession, d: str) -> DataFrame:
    """Course versions as web pages, cut into sections again."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    units = F.array_join(F.transform(F.coalesce("units", F.array()), lambda u: F.concat(F.lit("<h2>"), esc(u["title"]), F.lit("</h2><p>"), esc(u["text"]), F.lit("</p>"))), "")
    body = F.concat(F.lit("<nav>menu</nav><h1>"), esc(F.col("course_name")), F.lit("</h1><p>"), esc(F.col("objectives")), F.lit("</p>"), units)
    x = versions(spark, d).select("id", body.alias("html"))
    return P.html_sections(x, "id", "html").groupBy("key").agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"))
