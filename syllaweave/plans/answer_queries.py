"""Queries of the engine's answers, for many pairs and programmes at once, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from syllaweave.functions import rules
from syllaweave.operators import assemble as A, catalog as K, overlap as O, prerequisites as P
from syllaweave.plans import schedule_queries as S
from syllaweave.plans.assembly_queries import JOBS
from syllaweave.plans.catalog_queries import CTE, enriched, versions
from syllaweave.plans.lexical_queries import _CHUNKS, _terms
from syllaweave.session import written
from syllaweave.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TAU = 0.3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_H = "('0x' || substr(md5('42:' || family), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
_TEXT = "concat_ws(' ', coalesce(objectives, ''), array_to_string(list_transform(outcomes, lambda o: o.text), ' '), array_to_string(list_transform(units, lambda u: u.text), ' '))"
PAIRS = f"""{CTE}, pr0 AS (SELECT family, id AS id_a, lead(id) OVER (PARTITION BY family ORDER BY ay, id) AS id_b FROM e), prs AS (SELECT * FROM pr0 WHERE id_b IS NOT NULL)"""
FEATURES = f"""ch AS (SELECT id, {_CHUNKS} AS cs FROM c), un AS (SELECT id, generate_subscripts(cs, 1) - 1 AS ix, unnest(cs).label AS label, unnest(cs).text AS text FROM ch),
ut AS (SELECT id, ix, term, count(*) AS tf FROM (SELECT id, ix, unnest({_terms('text')}) AS term FROM un) GROUP BY ALL), uh AS (SELECT id, ix, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h, tf FROM ut),
u0 AS (SELECT id, ix, h % 256 AS dim, sum(CASE WHEN (h // 256) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(tf))) AS v FROM uh GROUP BY ALL HAVING abs(v) > 1e-9), uv AS (SELECT id, ix, dim, v / sqrt(sum(v * v) OVER (PARTITION BY id, ix)) AS v FROM u0),
ud AS (SELECT id, ix, any_value(label) AS label, list(coalesce(v, 0) ORDER BY dim) AS v FROM (SELECT id, ix, label, unnest(range(0, 256)) AS dim FROM un) LEFT JOIN uv USING (id, ix, dim) GROUP BY ALL),
sm AS (SELECT id_a, id_b, a.ix AS ia, b.ix AS ib, a.label AS la, b.label AS lb, round(list_dot_product(a.v, b.v), 9) AS s FROM prs JOIN ud a ON a.id = id_a JOIN ud b ON b.id = id_b), ma AS (SELECT id_a, id_b, ia, max(s) AS m FROM sm GROUP BY ALL), mb AS (SELECT id_a, id_b, ib, max(s) AS m FROM sm GROUP BY ALL),
fa AS (SELECT id_a, id_b, avg((m >= {TAU})::INT) AS cov_a, avg(m) AS mean_a, max(m) AS max_unit FROM ma GROUP BY ALL), fb AS (SELECT id_a, id_b, avg((m >= {TAU})::INT) AS cov_b, avg(m) AS mean_b FROM mb GROUP BY ALL),
fit AS (SELECT id FROM e WHERE {_H} < 0.6), ct AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_terms(_TEXT)}) AS term FROM c) GROUP BY ALL), fn AS (SELECT count(*) AS n FROM fit), cd AS (SELECT term, count(*) AS df FROM ct SEMI JOIN fit USING (id), fn GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.8::DOUBLE * n),
c0 AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + n)::DOUBLE / (1.0 + df)::DOUBLE) + 1) AS w0 FROM ct JOIN cd USING (term), fn), cw AS (SELECT id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY id)) AS w FROM c0), tc AS (SELECT id_a, id_b, sum(a.w * b.w) AS tfidf FROM prs JOIN cw a ON a.id = id_a JOIN cw b ON b.id = id_b AND b.term = a.term GROUP BY ALL),
ft AS (SELECT id_a, id_b, coalesce(cov_a, 0) AS cov_a, coalesce(cov_b, 0) AS cov_b, CASE WHEN cov_a + cov_b > 0 THEN 2 * cov_a * cov_b / (cov_a + cov_b) ELSE 0 END AS overlap, coalesce((mean_a + mean_b) / 2, 0) AS soft, coalesce(max_unit, 0) AS max_unit, coalesce(tfidf, 0) AS tfidf FROM prs LEFT JOIN fa USING (id_a, id_b) LEFT JOIN fb USING (id_a, id_b) LEFT JOIN tc USING (id_a, id_b)),
cf AS (SELECT *, 1 / (1 + exp(-(1.5476::DOUBLE * tfidf + 1.6914::DOUBLE * soft + 2.2568::DOUBLE * max_unit - 3.0684::DOUBLE))) AS confidence FROM ft)"""


def version_pairs(e: DataFrame) -> DataFrame:
    """Each version of a family with the next one."""
    return e.select("family", F.col("id").alias("id_a"), F.lead("id").over(Window.partitionBy("family").orderBy("ay", "id")).alias("id_b")).filter("id_b is not null")


def _training(e: DataFrame) -> DataFrame:
    return e.join(K.split_by_rank(e).filter("split = 'train'"), "family", "left_semi").select("id")


def _features(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    c = versions(spark, d)
    return O.features(pairs, c, _training(enriched(spark, d)), O.unit_vectors(c), TAU)


@query(f"WITH {PAIRS}, {FEATURES} SELECT id_a, id_b, round_even(round(overlap * 100, 9), 0)::INT || '%' AS percent, round(soft, 6) + 0.0::DOUBLE AS semantic, round(tfidf, 6) + 0.0::DOUBLE AS lexical, round(max_unit, 6) + 0.0::DOUBLE AS max_unit, round(confidence, 6) AS confidence, round(soft, 9) >= 0.664801061 AS warning FROM cf")
def ans_compare_courses(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive versions of each course compared: overlap, similarities, confidence and a redundancy warning."""
    x = _features(spark, d, version_pairs(enriched(spark, d)))
    return x.select("id_a", "id_b", O.percent(F.col("overlap")).alias("percent"), *((F.round(c, 6) + F.lit(0.0)).alias(n) for c, n in (("soft", "semantic"), ("tfidf", "lexical"), ("max_unit", "max_unit"))), F.round("confidence", 6).alias("confidence"), (F.round("soft", 9) >= 0.664801061).alias("warning"))


@query(f"""WITH {PAIRS}, {FEATURES}, ba AS (SELECT id_a, id_b, ia, la, lb, s FROM sm QUALIFY row_number() OVER (PARTITION BY id_a, id_b, ia ORDER BY s DESC, ib) = 1), bb AS (SELECT id_a, id_b, ib, lb, s FROM sm QUALIFY row_number() OVER (PARTITION BY id_a, id_b, ib ORDER BY s DESC, ia) = 1),
tp AS (SELECT id_a, id_b, 'common' AS kind, row_number() OVER (PARTITION BY id_a, id_b ORDER BY s DESC, ia) AS place, la AS topic, lb AS match, s FROM ba WHERE s >= {TAU} UNION ALL SELECT id_a, id_b, 'only a', row_number() OVER (PARTITION BY id_a, id_b ORDER BY ia), la, NULL, s FROM ba WHERE s < {TAU} UNION ALL SELECT id_a, id_b, 'only b', row_number() OVER (PARTITION BY id_a, id_b ORDER BY ib), lb, NULL, s FROM bb WHERE s < {TAU})
SELECT id_a, id_b, kind, place, topic, match, round(s, 6) + 0.0::DOUBLE AS similarity FROM tp WHERE place <= 10""")
def ans_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics that consecutive versions share, and those of one side only."""
    e = enriched(spark, d)
    t = O.pair_topics(version_pairs(e), O.unit_vectors(versions(spark, d)), TAU)
    return t.withColumns({"place": F.col("place").cast("bigint"), "similarity": F.round("similarity", 6) + F.lit(0.0)})


_HITS = f"""rp AS (SELECT id, family FROM e QUALIFY row_number() OVER (PARTITION BY family ORDER BY ay DESC, n_source_files DESC NULLS LAST, id DESC) = 1), qy AS (SELECT * FROM rp WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT % 100 = 0)"""


@query(f"""WITH {CTE}, {_HITS}, pr0 AS (SELECT family, id AS id_a, lead(id) OVER (PARTITION BY family ORDER BY ay, id) AS id_b FROM e), vp AS (SELECT id_a, id_b FROM pr0 WHERE id_b IS NOT NULL AND {_H} >= 0.6 AND {_H} < 0.8), prs AS (SELECT q.id AS id_a, r.id AS id_b FROM qy q JOIN rp r ON q.family <> r.family UNION ALL SELECT * FROM vp), {FEATURES},
ref AS (SELECT tfidf, soft FROM cf SEMI JOIN vp USING (id_a, id_b)), x AS (SELECT cf.* FROM cf ANTI JOIN vp USING (id_a, id_b)), fu AS (SELECT *, ((SELECT count(*) FROM ref WHERE ref.tfidf <= x.tfidf + 1e-12) / (SELECT count(*) FROM ref) + (SELECT count(*) FROM ref WHERE ref.soft <= x.soft + 1e-12) / (SELECT count(*) FROM ref)) / 2 AS fusion FROM x)
SELECT id_a, id_b, round(fusion, 6) AS score, row_number() OVER (PARTITION BY id_a ORDER BY round(fusion, 9) DESC, round(confidence, 9) DESC, id_b) AS place FROM fu QUALIFY place <= 5""")
def ans_find_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """For every hundredth representative (by a hash of its id) the five courses that overlap most, placed among validation pairs."""
    e = enriched(spark, d)
    reps = K.representatives(e).select("id", "family")
    q = reps.filter(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 100 == 0).select(F.col("id").alias("id_a"), F.col("family").alias("own"))
    pairs = q.join(reps.select(F.col("id").alias("id_b"), "family"), F.col("own") != F.col("family")).select("id_a", "id_b")  # a stated query set against all rows
    val = version_pairs(e).join(K.split_by_rank(e).filter("split = 'val'"), "family", "left_semi").select("id_a", "id_b")
    x = written(_features(spark, d, pairs.unionByName(val)).withColumns({"tfidf": F.round("tfidf", 9), "soft": F.round("soft", 9)}), "features")
    ref = x.join(val, ["id_a", "id_b"], "left_semi")
    hits = O.best_hits(O.fused(x.join(val, ["id_a", "id_b"], "left_anti"), ref), 5)
    return hits.select("id_a", "id_b", F.round("fusion", 6).alias("score"), F.col("place").cast("bigint").alias("place"))


@query(f"WITH {S.PRE} SELECT v.programme, v.family, CASE WHEN common THEN 'common course' WHEN v.sem IS NULL OR v.sem < 2 THEN 'first or unknown semester' WHEN cv.sem IS NULL THEN 'too little data' ELSE 'checked' END AS status FROM vw v LEFT JOIN cv ON cv.programme = v.programme AND cv.sem = v.sem")
def ans_checkable(spark: SparkSession, d: str) -> DataFrame:
    """Whether the prerequisites of a course can be checked in its programme, and why not."""
    e, _, covered, _ = S._schedule(spark, d)
    return P.check_status(K.programme_view(e.select("programmes", "common", "sem", "family", "ay", "id")), covered).select("programme", "family", "status")


_CW = "list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in rules.GENERIC_NAME_WORDS.split()) + ")), lambda t: regexp_replace(t, 's$', '')))"
_GAPS = f"""{CTE}, {JOBS}, th AS (SELECT regexp_replace(replace(lower(phrase), '&', 'and'), '[^a-z0-9]+', '', 'g') AS k, phrase, doc_id FROM jp), tm AS (SELECT k, min(phrase) AS theme, count(DISTINCT doc_id) AS n_jobs, count(DISTINCT phrase) AS n_phrases FROM th WHERE k <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
tw AS (SELECT theme, len(ws) AS n, unnest(ws) AS t FROM (SELECT theme, {_CW.format('theme')} AS ws FROM tm)), ux AS (SELECT DISTINCT regexp_replace(trim(x), '^[ \\-–]+|[ \\-–]+$', '', 'g') AS topic FROM (SELECT unnest(regexp_split_to_array(coalesce(u.text, ''), '[,;:.()]|\\bv/s\\b|\\bvs\\.?\\b')) AS x FROM (SELECT unnest(units) AS u FROM vw WHERE programme = 'COMP'))), uy AS (SELECT topic FROM ux WHERE length(topic) > 3 AND len(regexp_split_to_array(topic, '\\s+')) <= 12),
uw AS (SELECT topic, len(ws) AS n, unnest(ws) AS t FROM (SELECT topic, {_CW.format('topic')} AS ws FROM uy)), cs2 AS (SELECT theme, topic, count(*) / sqrt(any_value(tw.n) * any_value(uw.n)) AS s FROM tw JOIN uw USING (t) GROUP BY ALL), bt AS (SELECT theme, max(s) AS best FROM cs2 WHERE s >= 0.55 - 1e-9 GROUP BY 1),
gk AS (SELECT theme, n_jobs, n_phrases, round(coalesce(best, 0), 6) AS best, CASE WHEN best IS NOT NULL THEN 'covered' WHEN regexp_matches(theme, '{A.TOOLS}') THEN 'tool' ELSE 'gap' END AS kind FROM tm LEFT JOIN bt USING (theme))"""


@query(f"WITH {_GAPS} SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n_jobs DESC, n_phrases DESC, lower(theme), theme) AS place FROM gk")
def ans_skill_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Skills that two or more job descriptions ask for: covered by a topic of the computing programme, a tool for the lab, or a gap."""
    jobs = table(spark, d, "documents").filter("doc_kind = 'job_description'").select(F.col("doc_id").alias("job"), "text")
    units = K.programme_view(enriched(spark, d).select("programmes", "common", "family", "ay", "id", "units")).filter("programme = 'COMP'").select("id", F.explode("units").alias("u")).select("id", "u.title", "u.text")
    return A.skill_gaps(jobs, units).select("theme", "n_jobs", "n_phrases", F.round("best", 6).alias("best"), "kind", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {_GAPS}, u AS (SELECT regexp_replace(upper(substr(theme, 1, 1)) || substr(theme, 2), '\\s+', ' ', 'g') AS title, theme, n_jobs FROM gk WHERE kind = 'gap' QUALIFY row_number() OVER (ORDER BY n_jobs DESC, n_phrases DESC, lower(theme), theme) <= 4) SELECT title, 6 AS hours, n_jobs FROM u")
def ans_new_units(spark: SparkSession, d: str) -> DataFrame:
    """The new units of a draft: at most four gaps, the most wanted first."""
    g = ans_skill_gaps(spark, d).filter("kind = 'gap' and place <= 4")
    return g.select(F.regexp_replace(F.concat(F.upper(F.substring("theme", 1, 1)), F.substring("theme", 2, 1 << 20)), r"\s+", " ").alias("title"), F.lit(6).alias("hours"), "n_jobs")
