"""Queries of label-free tests, threshold grids and the outcome classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from syllaweave.operators import catalog as K, evaluation as E, prerequisites as P
from syllaweave.plans import schedule_queries as S
from syllaweave.plans.catalog_queries import CTE, enriched

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_GRID = [200.0, 400.0, 800.0, 1600.0, 3200.0]


@query(f"WITH {S.LAB}, t AS (SELECT unnest({_GRID})::DOUBLE AS tau) SELECT tau, round(count_if(y AND s >= tau) / count_if(y), 6) AS recall, round(count_if(NOT y AND s >= tau) / count_if(NOT y), 6) AS false_alarm, round(count_if(y AND s >= tau) / count_if(y) - count_if(NOT y AND s >= tau) / count_if(NOT y), 6) AS gain FROM d0, t GROUP BY tau")
def evl_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    g = E.threshold_grid(S._labelled(spark, d), "s", F.col("y"), ~F.col("y"), _GRID)
    return g.select("tau", *(F.round(c, 6).alias(c) for c in ("recall", "false_alarm", "gain")))


@query(f"""WITH {S.PRE}, n AS (SELECT family, arg_min(regexp_replace(replace(lower(course_name), '&', 'and'), '[^a-z0-9]+', '', 'g'), id) AS name FROM e GROUP BY 1 HAVING length(name) >= 5),
x AS (SELECT pk.programme, pk.family, pk.sem, pk.phrase, pk.k, n.family AS hit FROM pk JOIN n ON length(k) >= 5 AND (contains(name, k) OR contains(k, name)) JOIN er ON er.programme = pk.programme AND er.family = n.family AND er.first_sem < pk.sem WHERE n.family <> pk.family),
cs AS (SELECT programme, family, sem, phrase, k, min(hit) AS removed FROM x GROUP BY ALL HAVING count(DISTINCT hit) = 1),
z AS (SELECT cs.*, nm.resolved_family AS r, er.first_sem AS f FROM cs LEFT JOIN nm USING (k) LEFT JOIN er ON er.programme = cs.programme AND er.family = nm.resolved_family)
SELECT count(*) AS cases, round(avg(((r IS NULL OR r = removed OR f IS NULL OR f >= sem) AND r IS DISTINCT FROM family)::INT), 6) AS removal_recall, round(avg(((r IS NULL OR f IS NULL OR f >= sem) AND r IS DISTINCT FROM family)::INT), 6) AS intact_alarm FROM z""")
def evl_removal_test(spark: SparkSession, d: str) -> DataFrame:
    e, _, covered, first = S._schedule(spark, d)
    ph = S._phrases(e, covered)
    cases = P.removal_cases(ph, e, first).join(ph.select("phrase", "phrase_key").distinct(), "phrase")
    t = E.removal_test(cases, P.exact_names(e), first)
    return t.select("cases", F.round("removal_recall", 6).alias("removal_recall"), F.round("intact_alarm", 6).alias("intact_alarm"))


_INJ = f"{CTE}, u AS (SELECT programme, id, unnest(units).text AS text FROM vw), h AS (SELECT programme, id, text, row_number() OVER w AS n, lead(id) OVER w AS t FROM u WHERE text IS NOT NULL WINDOW w AS (PARTITION BY programme ORDER BY md5('42:' || id || ':' || text), id)), ij AS (SELECT programme, id AS source_owner, t AS target_owner, text FROM h WHERE n <= 60 AND t <> id)"


@query(f"WITH {_INJ} SELECT programme, source_owner, target_owner, md5(text) AS unit FROM ij")
def evl_injected_units(spark: SparkSession, d: str) -> DataFrame:
    u = K.programme_view(enriched(spark, d)).select("programme", "id", F.explode("units.text").alias("text"))
    return E.inject_units(u, "programme", "id", "text", 60).select("programme", "source_owner", "target_owner", F.md5("text").alias("unit"))


@query()
def blm_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Level of every outcome statement and what decided it, as counts."""
    o = S._outcomes(spark, d)
    tagged = o.filter("size(k) = 1").groupBy("text").agg(F.min(F.get("k", F.lit(0))).alias("y"))
    return E.outcome_classifier(tagged, o, S.blm_verb_map(spark, d)).groupBy("by", "level").agg(F.count("*").alias("n"))


@query(f"WITH {S.LBL} SELECT kind, count(*) AS n, count(p1) AS n1, count(p2) AS n2, count(p3) AS n3 FROM (SELECT kind, item, min(p1) AS p1, min(p2) AS p2, min(p3) AS p3 FROM lc GROUP BY ALL) GROUP BY 1")
def lab_merge(spark: SparkSession, d: str) -> DataFrame:
    l = S._labels(spark, d)
    items = l.select("item", "kind").distinct()
    m = E.merge_passes(items, [l.filter(f"p{i} is not null").select("item", F.col(f"p{i}").alias("label")) for i in (1, 2, 3)], "item")
    return m.groupBy("kind").agg(F.count("*").alias("n"), *(F.count(f"pass{i}").alias(f"n{i}") for i in (1, 2, 3)))


@query(f"""WITH {_INJ}, p AS (SELECT i.programme, i.source_owner, i.target_owner, i.text, len(list_intersect(list_distinct(regexp_extract_all(lower(i.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(coalesce(u.text, '')), '[a-z0-9]+')))) / greatest(1, len(list_distinct(list_concat(regexp_extract_all(lower(i.text), '[a-z0-9]+'), regexp_extract_all(lower(coalesce(u.text, '')), '[a-z0-9]+'))))) AS s, u.id = i.target_owner AS planted
FROM ij i JOIN (SELECT programme, id, text FROM u UNION ALL SELECT programme, target_owner, text FROM ij) u ON u.programme = i.programme AND u.id <> i.source_owner), b AS (SELECT programme, source_owner, text, max(s) FILTER (WHERE planted) AS t FROM p GROUP BY ALL),
r AS (SELECT p.programme, p.source_owner, p.text, 1 + count(*) FILTER (WHERE round(p.s, 9) > round(b.t, 9)) AS rank FROM p JOIN b USING (programme, source_owner, text) GROUP BY ALL) SELECT programme, count(*) AS n, round(avg((rank <= 20)::INT), 6) AS recall_20 FROM r GROUP BY 1""")
def evl_injection_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the injected units that stand among the twenty units of their programme that are closest to their source."""
    from syllaweave.functions.text import jaccard, words_of

    u = K.programme_view(enriched(spark, d)).select("programme", "id", F.explode("units.text").alias("text"))
    i = E.inject_units(u, "programme", "id", "text", 60)  # sixty for each programme
    both = u.unionByName(i.select("programme", F.col("target_owner").alias("id"), "text"))
    w = lambda c: F.array_distinct(words_of(F.col(c)))
    q = i.select("programme", "source_owner", "target_owner", F.col("text").alias("q"), w("text").alias("qw"))
    x = both.select("programme", "id", w("text").alias("w")).join(F.broadcast(q), "programme").filter("id <> source_owner")
    x = x.select("programme", "source_owner", "q", (F.col("id") == F.col("target_owner")).alias("planted"), F.round(jaccard(F.col("qw"), F.col("w")), 9).alias("s"))
    by = Window.partitionBy("programme", "source_owner", "q")
    t = x.withColumn("t", F.max(F.when(F.col("planted"), F.col("s"))).over(by)).groupBy("programme", "source_owner", "q").agg((1 + F.count_if(F.col("s") > F.col("t"))).alias("rank"))
    return t.groupBy("programme").agg(F.count("*").alias("n"), F.round(F.avg((F.col("rank") <= 20).cast("double")), 6).alias("recall_20"))
