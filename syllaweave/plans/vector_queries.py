"""Queries of the vector operators: a label is a programme, every fifth vector of it a course, a vector a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from syllaweave.operators import vectors as V
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


def units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("programme"), (F.col("vec_id") % 5).alias("course"), F.col("vec_id").alias("unit"), F.col("embedding").alias("vec"))


def _pairs(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    return V.unit_pairs(units(spark, d), "programme", "course", "unit", "vec", threshold)


def _best(spark: SparkSession, d: str) -> DataFrame:
    return V.unit_best(units(spark, d), "programme", "course", "unit", "vec")


CTE = f"""v AS (SELECT label::BIGINT AS programme, vec_id % 5 AS course, vec_id AS unit, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.programme, a.course AS course_a, b.course AS course_b, a.unit AS unit_a, b.unit AS unit_b, list_dot_product(a.e, b.e) AS sim FROM v a JOIN v b ON a.programme = b.programme AND a.course < b.course),
ma AS (SELECT programme, course_a, course_b, unit_a, max(sim) AS m FROM p GROUP BY ALL), mb AS (SELECT programme, course_a, course_b, unit_b, max(sim) AS m FROM p GROUP BY ALL),
ca AS (SELECT programme, course_a, course_b, avg((m >= {TAU})::INT) AS cov_a, avg(m) AS mean_a, max(m) AS max_unit FROM ma GROUP BY ALL),
cb AS (SELECT programme, course_a, course_b, avg((m >= {TAU})::INT) AS cov_b, avg(m) AS mean_b FROM mb GROUP BY ALL),
ms AS (SELECT programme, course_a, course_b, cov_a, cov_b, CASE WHEN cov_a + cov_b > 0 THEN 2 * cov_a * cov_b / (cov_a + cov_b) ELSE 0 END AS overlap, (mean_a + mean_b) / 2 AS soft, max_unit FROM ca JOIN cb USING (programme, course_a, course_b)),
mp0 AS (SELECT programme, course, i, avg(e[i]) AS x FROM v, range(1, 65) t(i) GROUP BY ALL), mp AS (SELECT programme, course, list(x ORDER BY i) AS m, sqrt(sum(x * x)) + 1e-9::DOUBLE AS n FROM mp0 GROUP BY ALL)"""


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"group": "programme", "owner_a": "course_a", "owner_b": "course_b", "ix_a": "unit_a", "ix_b": "unit_b"})


def _maxsim(spark: SparkSession, d: str) -> DataFrame:
    return _named(V.maxsim(_best(spark, d), TAU))


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    m = V.mean_pool(units(spark, d), ["programme", "course"], "vec")
    a, b = (m.select("programme", F.col("course").alias(f"course_{x}"), F.col("vec").alias(f"vec_{x}")) for x in "ab")
    return a.join(b, "programme").filter("course_a < course_b").select("programme", "course_a", "course_b", V.dot(F.col("vec_a"), F.col("vec_b")).alias("pooled"))


@query(f"WITH {CTE} SELECT programme, course_a, course_b, round(cov_a, 6) AS cov_a, round(cov_b, 6) AS cov_b, round(overlap, 6) AS overlap, round(soft, 6) AS soft FROM ms")
def ov_maxsim(spark: SparkSession, d: str) -> DataFrame:
    return _maxsim(spark, d).select("programme", "course_a", "course_b", *(F.round(c, 6).alias(c) for c in ("cov_a", "cov_b", "overlap", "soft")))


@query(f"WITH {CTE} SELECT programme, course_a, course_b, round(max_unit, 6) AS max_unit FROM ms")
def ov_max_unit(spark: SparkSession, d: str) -> DataFrame:
    return _maxsim(spark, d).select("programme", "course_a", "course_b", F.round("max_unit", 6).alias("max_unit"))


_POOLED = "mq AS (SELECT a.programme, a.course AS course_a, b.course AS course_b, list_dot_product(a.m, b.m) / a.n / b.n AS pooled FROM mp a JOIN mp b ON a.programme = b.programme AND a.course < b.course)"


@query(f"WITH {CTE}, {_POOLED} SELECT programme, course_a, course_b, round(pooled, 6) AS pooled FROM mq")
def ov_meanpool(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d).withColumn("pooled", F.round("pooled", 6))


@query(f"WITH {CTE}, o AS (SELECT programme, course_a, course_b, unit_a, unit_b, sim FROM p WHERE sim >= {TAU} QUALIFY row_number() OVER (PARTITION BY programme, course_a, course_b ORDER BY sim DESC, unit_a, unit_b) = 1) SELECT programme, course_a, course_b, unit_a, unit_b, round(sim, 6) AS sim FROM o ORDER BY o.sim DESC, programme, unit_a, unit_b LIMIT 20")
def red_units(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most similar unit pairs, one for each pair of courses (a top-k report)."""
    return _named(V.best_unit_pairs(_pairs(spark, d, TAU), 20)).withColumn("sim", F.round("sim", 6))


@query(f"WITH {CTE} SELECT programme, course_a, course_b, unit_a, unit_b, round(sim, 6) AS sim FROM p WHERE sim >= {TAU}")
def red_flags(spark: SparkSession, d: str) -> DataFrame:
    return _named(_pairs(spark, d, TAU)).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {CTE}, t AS (SELECT row_number() OVER (ORDER BY topic) - 1 AS no, * FROM (SELECT DISTINCT topic, programmes, verified FROM emerging_topics WHERE verified)), tp AS (SELECT topic, no, unnest(programmes) AS name FROM t),
pn AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS p FROM (SELECT DISTINCT name FROM tp)), q AS (SELECT topic, name, p % 10 AS programme, v.e AS te FROM tp JOIN pn USING (name) JOIN v ON v.unit = no),
s AS (SELECT q.topic, q.name, v.unit, list_dot_product(te, e) AS sim FROM q JOIN v ON v.programme = q.programme QUALIFY row_number() OVER (PARTITION BY q.topic, q.name ORDER BY sim DESC, v.unit) <= 5)
SELECT topic, name AS programme, max(sim) >= {TAU} AS covered, round(max(sim), 6) AS best, array_to_string(list(unit ORDER BY sim DESC, unit), ';') AS evidence FROM s GROUP BY ALL""")
def emg_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Does a programme teach a verified emerging topic? The n-th topic by name has the n-th vector, the n-th programme the n-th label (over ten)."""
    u = units(spark, d)
    t = table(spark, d, "emerging_topics").filter("verified").select("topic", "programmes").distinct()
    one = Window.partitionBy(F.lit(0))  # a list of forty topics
    t = t.withColumn("unit", (F.row_number().over(one.orderBy("topic")) - 1).cast("bigint"))
    t = t.select("topic", "unit", F.explode("programmes").alias("name"))
    p = t.select("name").distinct().withColumn("p", F.row_number().over(one.orderBy("name")) - 1)
    q = t.join(p, "name").join(u.select("unit", "vec"), "unit").select("topic", "name", (F.col("p") % 10).cast("bigint").alias("programme"), "vec").withColumn("q", F.xxhash64("topic", "name"))
    s = V.nearest(q, u.withColumn("bucket", F.lit(0).cast("bigint")), "programme", "q", "bucket", "unit", "vec", 5).join(q.select("q", "topic", "name"), "q")
    best = F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col("ix").alias("i"))))
    return s.groupBy("topic", F.col("name").alias("programme")).agg((F.max("sim") >= TAU).alias("covered"), F.round(F.max("sim"), 6).alias("best"), F.array_join(F.transform(best, lambda x: x["i"].cast("string")), ";").alias("evidence"))


@query(f"""WITH {CTE}, j AS (SELECT theme, item, ('0x' || substr(md5(theme), 1, 8))::BIGINT AS t, ('0x' || substr(md5(item), 1, 8))::BIGINT AS i FROM (SELECT DISTINCT theme, item FROM jdskills_llm WHERE theme IS NOT NULL AND item IS NOT NULL)), m AS (SELECT count(*) AS n FROM v),
ph AS (SELECT theme, t % 10 AS programme, e AS te FROM j, m JOIN v ON v.unit = j.i % m.n),
s AS (SELECT theme, v.course, v.unit, max(list_dot_product(te, e)) AS sim FROM ph JOIN v ON v.programme = ph.programme GROUP BY ALL),
o AS (SELECT theme, course, unit, sim FROM s QUALIFY row_number() OVER (PARTITION BY theme, course ORDER BY sim DESC, unit) = 1)
SELECT theme, course, unit, round(sim, 6) AS sim, row_number() OVER (PARTITION BY theme ORDER BY o.sim DESC, unit) AS rank FROM o QUALIFY rank <= 3""")
def mod_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Closest units to each skill theme: the best over all of its phrases, one unit for each course, three in all.

    A phrase has the vector, and a theme the programme, that a hash of its name picks.
    """
    u = units(spark, d)
    n = u.count()
    j = table(spark, d, "jdskills_llm").select("theme", "item").filter("theme is not null and item is not null").distinct()
    number = lambda c, m: (F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % m)
    ph = j.select("theme", number("theme", 10).alias("programme"), number("item", n).alias("unit"), F.xxhash64("theme", "item").alias("q"))
    ph = ph.join(u.select("unit", "vec"), "unit").select("theme", "programme", "q", "vec")
    s = V.nearest(ph, u, "programme", "q", "course", "unit", "vec").join(ph.select("q", "theme"), "q")
    o = s.withColumn("n", F.row_number().over(Window.partitionBy("theme", "course").orderBy(F.desc("sim"), "ix"))).filter("n = 1")
    o = o.withColumn("rank", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("sim"), "ix"))).filter("rank <= 3")
    return o.select("theme", "course", F.col("ix").alias("unit"), F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {CTE}, q AS (SELECT programme, unit AS phrase, e AS qe FROM v WHERE unit % 7 = 0), s AS (SELECT q.programme, phrase, unit AS resolved, list_dot_product(qe, e) AS sim, course = 0 AS prefer FROM q JOIN v ON v.programme = q.programme AND v.unit % 7 <> 0),
r AS (SELECT programme, phrase, resolved, sim, prefer FROM s WHERE sim >= {TAU} QUALIFY row_number() OVER (PARTITION BY programme, phrase ORDER BY prefer DESC, sim DESC, resolved) = 1)
SELECT q.programme, q.phrase, r.resolved, round(r.sim, 6) AS sim, coalesce(r.prefer, false) AS preferred FROM q LEFT JOIN r USING (programme, phrase)""")
def pre_embed_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The unit that a phrase vector means: the most similar preferred one (course 0) if any is similar enough, else any; NULL if none."""
    u = units(spark, d)
    q = u.filter("unit % 7 = 0").select("programme", F.col("unit").alias("phrase"), "vec")
    s = V.nearest(q, u.filter("unit % 7 <> 0"), "programme", "phrase", "course", "unit", "vec").filter(F.col("sim") >= TAU)
    prefer = F.col("course") == 0
    best = F.max_by(F.struct("ix", "sim", prefer.alias("p")), F.struct(prefer, F.col("sim"), -F.col("ix")))
    r = s.groupBy("programme", "phrase").agg(best.alias("b"))
    return q.select("programme", "phrase").join(r, ["programme", "phrase"], "left").select("programme", "phrase", F.col("b.ix").alias("resolved"), F.round("b.sim", 6).alias("sim"), F.coalesce("b.p", F.lit(False)).alias("preferred"))


@query(f"""WITH {CTE}, w AS (SELECT programme, unit, unit % 8 + 1 AS sem, e FROM v)
SELECT a.programme, a.unit AS phrase, a.sem, round(coalesce(max(list_dot_product(a.e, b.e)), 0.0), 6) AS best, coalesce(max(list_dot_product(a.e, b.e)), 0.0) >= {TAU} AS taught FROM w a LEFT JOIN w b ON a.programme = b.programme AND b.sem < a.sem WHERE a.unit % 7 = 0 GROUP BY ALL""")
def pre_topic_check(spark: SparkSession, d: str) -> DataFrame:
    """Is the topic of a phrase taught by a unit of an earlier semester (0 where there is none)? The best of each semester first, then the earlier ones."""
    u = units(spark, d).withColumn("sem", F.col("unit") % 8 + 1)
    q = u.filter("unit % 7 = 0").select("programme", F.col("unit").alias("phrase"), F.col("sem").alias("at"), "vec")
    s = V.nearest(q, u, "programme", "phrase", "sem", "unit", "vec")
    best = q.select("programme", "phrase", "at").join(s, ["programme", "phrase"], "left").groupBy("programme", "phrase", "at").agg(F.coalesce(F.max(F.when(F.col("sem") < F.col("at"), F.col("sim"))), F.lit(0.0)).alias("best"))
    return best.select("programme", "phrase", F.col("at").alias("sem"), F.round("best", 6).alias("best"), (F.col("best") >= TAU).alias("taught"))


@query(f"""WITH {CTE}, q AS (SELECT programme, unit, course, e FROM v WHERE unit % 7 = 0) SELECT q.programme, q.unit AS phrase, coalesce(max(list_dot_product(q.e, v.e)), 0.0) >= {TAU} AS own FROM q LEFT JOIN v ON q.programme = v.programme AND q.course = v.course AND q.unit <> v.unit GROUP BY ALL""")
def pre_own_content(spark: SparkSession, d: str) -> DataFrame:
    """Does the course that names a phrase teach it itself?"""
    u = units(spark, d)
    q = u.filter("unit % 7 = 0").select("programme", F.col("unit").alias("phrase"), F.col("course").alias("at"), "vec")
    s = V.nearest(q, u, "programme", "phrase", "course", "unit", "vec", 2).filter("phrase <> ix")
    hit = s.join(q.select("phrase", "at"), "phrase").filter("course = at").groupBy("phrase").agg(F.max("sim").alias("s"))
    return q.select("programme", "phrase").join(hit, "phrase", "left").select("programme", "phrase", (F.coalesce("s", F.lit(0.0)) >= TAU).alias("own"))


@query(f"""WITH RECURSIVE {CTE}, ed AS (SELECT unit_a AS x, unit_b AS y FROM p WHERE sim >= 0.35 UNION SELECT unit_b, unit_a FROM p WHERE sim >= 0.35), r AS (SELECT x, x AS y FROM ed UNION SELECT r.x, ed.y FROM r JOIN ed ON r.y = ed.x),
c AS (SELECT x AS unit, min(y) AS root FROM r GROUP BY x) SELECT root, count(DISTINCT course) AS owners, count(*) AS units FROM c JOIN v USING (unit) GROUP BY 1 HAVING count(DISTINCT course) >= 2""")
def mod_shared_units(spark: SparkSession, d: str) -> DataFrame:
    m = units(spark, d).select(F.col("unit").alias("ix"), F.col("course").alias("owner"))
    s = V.shared_units(_pairs(spark, d, 0.35), m)
    return s.groupBy("root").agg(F.max("owners").alias("owners"), F.count("*").alias("units"))


FROZEN = {"soft": (0.2, 0.05, 1.1), "max_unit": (0.3, 0.05, 0.7), "pooled": (0.0, 0.1, 0.4)}
_Z = "1 / (1 + exp(-(-0.5::DOUBLE + 1.1::DOUBLE * (soft - 0.2::DOUBLE) / 0.05::DOUBLE + 0.7::DOUBLE * (max_unit - 0.3::DOUBLE) / 0.05::DOUBLE + 0.4::DOUBLE * (pooled - 0.0::DOUBLE) / 0.1::DOUBLE)))"


@query(f"WITH {CTE}, {_POOLED} SELECT programme, course_a, course_b, round({_Z}, 6) AS confidence FROM ms JOIN mq USING (programme, course_a, course_b)")
def ov_confidence(spark: SparkSession, d: str) -> DataFrame:
    x = _maxsim(spark, d).join(_pooled(spark, d), ["programme", "course_a", "course_b"])
    return x.select("programme", "course_a", "course_b", F.round(V.logistic(FROZEN, -0.5), 6).alias("confidence"))


@query(f"WITH {CTE}, {_POOLED}, x AS (SELECT programme, course_a, course_b, round(soft, 9) AS soft, round(pooled, 9) AS pooled FROM ms JOIN mq USING (programme, course_a, course_b)) SELECT programme, course_a, course_b, round(((rank() OVER (ORDER BY soft) + (count(*) OVER (PARTITION BY soft) - 1) / 2) / count(*) OVER () + (rank() OVER (ORDER BY pooled) + (count(*) OVER (PARTITION BY pooled) - 1) / 2) / count(*) OVER ()) / 2, 6) AS fused FROM x")
def ov_fusion_rank(spark: SparkSession, d: str) -> DataFrame:
    x = _maxsim(spark, d).join(_pooled(spark, d), ["programme", "course_a", "course_b"]).withColumns({"soft": F.round("soft", 9), "pooled": F.round("pooled", 9), "one": F.lit(1)})
    x = V.average_ranks(V.average_ranks(x, ["one"], "soft", "r1"), ["one"], "pooled", "r2")
    return x.select("programme", "course_a", "course_b", F.round((F.col("r1") + F.col("r2")) / 2, 6).alias("fused"))


@query(f"WITH {CTE}, {_POOLED}, x AS (SELECT programme, course_a, course_b, round(soft, 9) AS soft, round(pooled, 9) AS pooled FROM ms JOIN mq USING (programme, course_a, course_b)), ref AS (SELECT * FROM x WHERE programme < 3) SELECT programme, course_a, course_b, round(((SELECT count(*) FROM ref WHERE ref.soft <= x.soft) / (SELECT count(*) FROM ref) + (SELECT count(*) FROM ref WHERE ref.pooled <= x.pooled) / (SELECT count(*) FROM ref)) / 2, 6) AS fused FROM x")
def ov_fusion_ecdf(spark: SparkSession, d: str) -> DataFrame:
    """Scores as shares of a reference list (the pairs of three programmes), averaged."""
    x = _maxsim(spark, d).join(_pooled(spark, d), ["programme", "course_a", "course_b"]).withColumns({"soft": F.round("soft", 9), "pooled": F.round("pooled", 9)})
    ref = x.filter("programme < 3")
    x = V.empirical_cdf(V.empirical_cdf(x, "soft", ref.select("soft"), "r1"), "pooled", ref.select("pooled"), "r2")
    return x.select("programme", "course_a", "course_b", F.round((F.col("r1") + F.col("r2")) / 2, 6).alias("fused"))


@query(f"""WITH {CTE}, b AS (SELECT programme, course_a, course_b, unit_a, arg_max(unit_b, sim) AS unit_b, max(sim) AS sim FROM p GROUP BY ALL)
SELECT programme, course_a, course_b, count_if(sim >= {TAU})::BIGINT AS n_common, count_if(sim < {TAU})::BIGINT AS n_unique_a, coalesce(array_to_string((list(unit_a || '~' || unit_b ORDER BY sim DESC, unit_a) FILTER (WHERE sim >= {TAU}))[1:12], ';'), '') AS common FROM b GROUP BY ALL""")
def ov_topics(spark: SparkSession, d: str) -> DataFrame:
    """Units of the first course with a match in the second (best first, twelve at most shown), and how many have none."""
    by = ["programme", "course_a", "course_b"]
    b = _best(spark, d).filter("owner < other").toDF("programme", "course_a", "unit_a", "course_b", "unit_b", "sim")
    hit = F.col("sim") >= TAU
    best = F.sort_array(F.collect_list(F.when(hit, F.struct((-F.col("sim")).alias("s"), "unit_a", "unit_b"))))
    return b.groupBy(*by).agg(F.count_if(hit).alias("n_common"), F.count_if(~hit).alias("n_unique_a"), F.array_join(F.slice(F.transform(best, lambda x: F.concat_ws("~", x["unit_a"], x["unit_b"])), 1, 12), ";").alias("common"))
