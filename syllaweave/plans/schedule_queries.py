"""Queries of prerequisites, differences, outcomes, labels and measures, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from syllaweave.functions import course as C, rules
from syllaweave.operators import catalog as K, diff as D, metrics as M, prerequisites as P
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


_STRIP = "regexp_replace({0}, '^[ .:\\-–]+|[ .:\\-–]+$', '', 'g')"
_NONE = rules.NONE_PREREQUISITE
_SPLIT1 = f"""CASE WHEN trim(t) = '' OR regexp_matches(trim(t), '{_NONE}') THEN [] ELSE
list_filter(list_transform(regexp_split_to_array(t, '[;,\\n]|\\band\\b|&|\\bas well as\\b|\\bor\\b|/'), lambda x: regexp_replace({_STRIP.format("trim(regexp_replace(x, '\\s+', ' ', 'g'))")}, '{rules.LEAD_IN}', '')), lambda x: length(x) > 2 AND length(x) <= 90 AND NOT regexp_matches(x, '{_NONE}')) END"""
PRE = f"""{CTE}, nf AS (SELECT programme, sem, count(DISTINCT family) AS n FROM st GROUP BY ALL HAVING count(DISTINCT family) >= 3),
vc AS (SELECT programme FROM (SELECT unnest(programmes) AS programme FROM e) GROUP BY 1 HAVING count(*) >= 50),
cv AS (SELECT vc.programme, s.sem FROM vc, (SELECT unnest(range(1, 11))::INT AS sem) s WHERE (SELECT count(*) FROM nf WHERE nf.programme = vc.programme AND nf.sem >= 1 AND nf.sem < s.sem) = s.sem - 1),
er AS (SELECT programme, family, min(sem) AS first_sem FROM st WHERE sem >= 1 GROUP BY ALL),
ck AS (SELECT vw.* FROM vw JOIN cv USING (programme, sem) WHERE NOT common AND sem >= 2),
ph0 AS (SELECT programme, family, sem, regexp_replace(coalesce(prerequisites, ''), '\\(([^)]*\\d[^)]*)\\)', ' ', 'g') AS t FROM ck),
ph AS (SELECT DISTINCT programme, family, sem, unnest({_SPLIT1}) AS phrase FROM ph0),
pk AS (SELECT *, regexp_replace(replace(lower(phrase), '&', 'and'), '[^a-z0-9]+', '', 'g') AS k FROM ph),
nm AS (SELECT regexp_replace(replace(lower(course_name), '&', 'and'), '[^a-z0-9]+', '', 'g') AS k, arg_min(family, id) AS resolved_family FROM e GROUP BY 1 HAVING k <> '')"""


def _schedule(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e = enriched(spark, d)
    st = K.structure(e)
    return e, st, P.coverage(st, K.version_counts(e)), P.earlier(st)


def _phrases(e: DataFrame, covered: DataFrame, v2: bool = False) -> DataFrame:
    view = K.programme_view(e.select("programmes", "common", "sem", "family", "ay", "id", "course_name", "prerequisites"))
    return P.phrases(P.checkable(view, covered), C.split_prerequisites_v2(F.col("prerequisites")) if v2 else C.split_prerequisites(F.col("prerequisites")))


@query(f"WITH {CTE}, x AS (SELECT id, regexp_replace(coalesce(prerequisites, ''), '\\(([^)]*\\d[^)]*)\\)', ' ', 'g') AS t FROM c), y AS (SELECT id, unnest({_SPLIT1}) AS phrase FROM x) SELECT DISTINCT id, phrase FROM y")
def pre_split(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("id", F.explode(C.split_prerequisites(F.col("prerequisites"))).alias("phrase"))


@query(f"WITH {PRE} SELECT programme, family, first_sem FROM er")
def pre_earlier(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d)[3]


@query(f"WITH {PRE} SELECT programme, sem FROM cv")
def pre_covered(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d)[2]


@query(f"WITH {PRE} SELECT k AS phrase_key, resolved_family FROM nm")
def pre_exact_names(spark: SparkSession, d: str) -> DataFrame:
    return P.exact_names(enriched(spark, d))


@query(f"""WITH {PRE}, r AS (SELECT pk.*, nm.resolved_family, er.first_sem FROM pk LEFT JOIN nm ON pk.k = nm.k LEFT JOIN er ON er.programme = pk.programme AND er.family = nm.resolved_family WHERE nm.resolved_family IS NULL OR nm.resolved_family <> pk.family)
SELECT programme, family, sem, phrase, resolved_family, CASE WHEN resolved_family IS NULL THEN 'unresolved' ELSE 'not_offered_earlier' END AS type FROM r WHERE resolved_family IS NULL OR first_sem IS NULL OR first_sem >= sem""")
def pre_flags(spark: SparkSession, d: str) -> DataFrame:
    e, _, covered, first = _schedule(spark, d)
    return P.flags(_phrases(e, covered), P.exact_names(e), first)


@query(f"""WITH {PRE}, n AS (SELECT family, arg_min(regexp_replace(replace(lower(course_name), '&', 'and'), '[^a-z0-9]+', '', 'g'), id) AS name FROM e GROUP BY 1 HAVING length(name) >= 5),
x AS (SELECT pk.programme, pk.family, pk.sem, pk.phrase, n.family AS hit FROM pk JOIN n ON length(k) >= 5 AND (contains(name, k) OR contains(k, name)) JOIN er ON er.programme = pk.programme AND er.family = n.family AND er.first_sem < pk.sem WHERE n.family <> pk.family)
SELECT programme, family, sem, phrase, min(hit) AS removed_family FROM x GROUP BY ALL HAVING count(DISTINCT hit) = 1""")
def pre_removal_cases(spark: SparkSession, d: str) -> DataFrame:
    e, _, covered, first = _schedule(spark, d)
    return P.removal_cases(_phrases(e, covered), e, first)


_MARKS2 = "regexp_replace({0}, '^[ .:\\-–]+|[ .:\\-–]+$', '', 'g')"
_CODES = "list_filter(regexp_extract_all(t1, '\\b[A-Z0-9]{6,}\\b'), lambda w: regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Z]'))"
_SIDES = f"list_transform(regexp_split_to_array(p, '\\band\\b|&|\\bas well as\\b|\\bor\\b'), lambda s: {_MARKS2.format('s')})"
SPLIT2 = f"""s0 AS (SELECT id, regexp_replace(coalesce(prerequisites, ''), '\\([^)]*\\)?', ' ', 'g') AS t1 FROM c), s1 AS (SELECT id, CASE WHEN len({_CODES}) > 0 THEN regexp_replace(t1, '\\b(?:' || array_to_string({_CODES}, '|') || ')\\b', ' ', 'g') ELSE t1 END AS t FROM s0),
s2 AS (SELECT id, list_transform(regexp_split_to_array(t, '[;,\\n/]'), lambda p: regexp_replace({_MARKS2.format("trim(regexp_replace(p, '\\s+', ' ', 'g'))")}, '{rules.LEAD_IN}', '')) AS ps FROM s1 WHERE NOT (trim(t) = '' OR regexp_matches(trim(t), '{_NONE}'))),
s3 AS (SELECT id, list_transform(flatten(list_transform(ps, lambda p: CASE WHEN len({_SIDES}) > 1 AND len(list_filter({_SIDES}, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) < 2)) = 0 THEN {_SIDES} ELSE [p] END)), lambda q: regexp_replace(q, '{rules.LEAD_IN}', '')) AS qs FROM s2),
s4 AS (SELECT id, 0 AS k, qs, []::VARCHAR[] AS out FROM s3 UNION ALL SELECT id, k + 1, qs, list_concat(out, CASE WHEN len(out) > 0 AND regexp_matches(qs[k + 1], '{rules.PART_NUMBERS}') THEN list_transform(regexp_extract_all(qs[k + 1], '{rules.PART_NUMBER}'), lambda n: regexp_replace(out[-1], '{rules.PART_NUMBER_AT_END}', '') || ' - ' || upper(n)) WHEN length(qs[k + 1]) > 2 AND length(qs[k + 1]) <= 90 AND NOT regexp_matches(qs[k + 1], '{_NONE}') THEN [qs[k + 1]] ELSE [] END) FROM s4 WHERE k < len(qs)),
s5 AS (SELECT id, out FROM s4 WHERE k = len(qs)), s6 AS (SELECT id, unnest(out) AS phrase, generate_subscripts(out, 1) AS i FROM s5), s7 AS (SELECT id, phrase, min(i) AS i FROM s6 GROUP BY ALL)"""


@query(f"WITH RECURSIVE {CTE}, {SPLIT2} SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, phrase FROM s7")
def pre_split_v2(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("id", F.posexplode(C.split_prerequisites_v2(F.col("prerequisites"))).alias("pos", "phrase")).withColumn("pos", F.col("pos").cast("bigint"))


@query()
def pre_flags_v2(spark: SparkSession, d: str) -> DataFrame:
    e, _, covered, first = _schedule(spark, d)
    units = versions(spark, d).select("id", P.topics(F.col("units")).alias("texts"))
    view = P.checkable(K.programme_view(e.select("programmes", "common", "sem", "family", "ay", "id", "course_name", "prerequisites")), covered)
    own = view.select("programme", "family", "id").join(units, "id").select("programme", "family", F.explode("texts").alias("text")).distinct()
    shown = K.representatives(e.select("family", "id", "ay", "n_source_files")).select("family", "id")
    taught = shown.join(units, "id").select("family", F.explode("texts").alias("text")).distinct()
    return P.flags_v2(_phrases(e, covered, v2=True), P.exact_names(e), first, e, own, taught)


DIF = f"""{CTE}, s AS (SELECT programme, ay, count(*) AS n FROM sn GROUP BY ALL HAVING count(*) >= 10), y AS (SELECT ay, lead(ay) OVER (ORDER BY ay) AS next_ay FROM (SELECT DISTINCT ay FROM e WHERE ay <> '')),
yp AS (SELECT a.programme, a.ay, y.next_ay FROM s a JOIN y ON a.ay = y.ay JOIN s b ON a.programme = b.programme AND b.ay = y.next_ay),
sk AS (SELECT programme, ay, regexp_replace(replace(lower(course_name), '&', 'and'), '[^a-z0-9]+', '', 'g') AS name_key, max(family) AS family FROM sn GROUP BY ALL),
da AS (SELECT yp.*, name_key, family AS family_a FROM yp JOIN sk ON yp.programme = sk.programme AND yp.ay = sk.ay), db AS (SELECT yp.*, name_key, family AS family_b FROM yp JOIN sk ON yp.programme = sk.programme AND yp.next_ay = sk.ay),
dn AS (SELECT programme, ay, next_ay, name_key, family_a, family_b, CASE WHEN family_b IS NULL THEN 'removed' WHEN family_a IS NULL THEN 'added' ELSE 'retained' END AS change FROM da FULL JOIN db USING (programme, ay, next_ay, name_key)),
ta AS (SELECT DISTINCT yp.programme, yp.ay, yp.next_ay, family FROM yp JOIN sn ON yp.programme = sn.programme AND yp.ay = sn.ay), tb AS (SELECT DISTINCT yp.programme, yp.ay, yp.next_ay, family FROM yp JOIN sn ON yp.programme = sn.programme AND yp.next_ay = sn.ay),
tc AS (SELECT *, 'removed' AS change FROM (SELECT * FROM ta EXCEPT SELECT * FROM tb) UNION ALL SELECT *, 'added' FROM (SELECT * FROM tb EXCEPT SELECT * FROM ta)),
cl AS (SELECT DISTINCT programme, ay, next_ay, coalesce(family_a, family_b) AS family, change FROM dn WHERE change <> 'retained')"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = enriched(spark, d).select("id", "ay", "family", "programmes", "course_name")
    return K.snapshot(e), K.year_pairs(e)


@query(f"WITH {DIF} SELECT programme, ay, next_ay, change, count(*) AS n FROM dn GROUP BY ALL")
def dif_by_name(spark: SparkSession, d: str) -> DataFrame:
    return D.by_name(*_snapshots(spark, d)).groupBy("programme", "ay", "next_ay", "change").agg(F.count("*").alias("n"))


@query(f"WITH {DIF} SELECT programme, ay, next_ay, name_key, family_a, family_b, change FROM dn WHERE change <> 'retained'")
def dif_changes(spark: SparkSession, d: str) -> DataFrame:
    return D.by_name(*_snapshots(spark, d)).filter("change <> 'retained'").select("programme", "ay", "next_ay", "name_key", "family_a", "family_b", "change")


@query(f"WITH {DIF}, n AS (SELECT (SELECT count(*) FROM (SELECT * FROM cl INTERSECT SELECT * FROM tc)) AS tp, (SELECT count(*) FROM cl) AS claimed, (SELECT count(*) FROM tc) AS real) SELECT tp, claimed, real, round(tp / claimed, 6) AS precision, round(tp / real, 6) AS recall FROM n")
def dif_score(spark: SparkSession, d: str) -> DataFrame:
    s, p = _snapshots(spark, d)
    return D.score(D.by_name(s, p), D.true_changes(s, p)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


_GREEDY = f"""wv AS (SELECT id, list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(objectives, ''), array_to_string(list_transform(outcomes, lambda o: o.text), ' '), array_to_string(list_transform(units, lambda u: u.text), ' '))), '[a-z]{{4,}}')) AS ws FROM c),
sw AS (SELECT programme, ay, family, ws FROM sn JOIN wv USING (id)), ra AS (SELECT dn.programme, dn.ay, dn.next_ay, family_a AS a, ws FROM dn JOIN sw ON sw.programme = dn.programme AND sw.ay = dn.ay AND sw.family = family_a WHERE change = 'removed'), rb AS (SELECT dn.programme, dn.ay, dn.next_ay, family_b AS b, ws FROM dn JOIN sw ON sw.programme = dn.programme AND sw.ay = dn.next_ay AND sw.family = family_b WHERE change = 'added'),
rc AS (SELECT programme, ay, next_ay, a, b, len(list_intersect(ra.ws, rb.ws)) / len(list_distinct(list_concat(ra.ws, rb.ws))) AS s FROM ra JOIN rb USING (programme, ay, next_ay) WHERE len(list_intersect(ra.ws, rb.ws)) > 0), rk2 AS (SELECT *, row_number() OVER (PARTITION BY programme, ay, next_ay ORDER BY s DESC, a DESC, b DESC) AS k FROM rc WHERE s >= 0.05),
gm AS (SELECT DISTINCT programme, ay, next_ay, 0::BIGINT AS k, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub, NULL::DOUBLE AS s FROM rk2 UNION ALL SELECT gm.programme, gm.ay, gm.next_ay, r.k, CASE WHEN list_contains(ua, r.a) OR list_contains(ub, r.b) THEN ua ELSE list_append(ua, r.a) END, CASE WHEN list_contains(ua, r.a) OR list_contains(ub, r.b) THEN ub ELSE list_append(ub, r.b) END, CASE WHEN list_contains(ua, r.a) OR list_contains(ub, r.b) THEN NULL ELSE r.s END FROM gm JOIN rk2 r ON r.programme = gm.programme AND r.ay = gm.ay AND r.next_ay = gm.next_ay AND r.k = gm.k + 1)"""


@query(f"WITH RECURSIVE {DIF}, {_GREEDY} SELECT programme, ay, next_ay, ua[-1] AS a, ub[-1] AS b, round(s, 6) AS s FROM gm WHERE s IS NOT NULL")
def dif_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Removed and added courses of two years matched one to one where a twentieth of their words agrees."""
    s, p = _snapshots(spark, d)
    c = D.by_name(s, p).filter("change <> 'retained'")
    w = versions(spark, d).select("id", F.array_distinct(F.regexp_extract_all(F.lower(C.course_text()), F.lit("[a-z]{4,}"), F.lit(0))).alias("ws"))
    words = s.join(w, "id").select("programme", "ay", "family", "ws")
    by = ["programme", "ay", "next_ay"]
    a = c.filter("change = 'removed'").select(*by, F.col("family_a").alias("family")).join(words, ["programme", "ay", "family"]).select(*by, F.col("family").alias("a"), F.col("ws").alias("wa"))
    b = c.filter("change = 'added'").select(*by, F.col("family_b").alias("family")).join(words.withColumnRenamed("ay", "next_ay"), ["programme", "next_ay", "family"]).select(*by, F.col("family").alias("b"), F.col("ws").alias("wb"))
    # candidates meet over their words within one programme and year pair
    meet = a.select(*by, "a", F.explode("wa").alias("w")).join(b.select(*by, "b", F.explode("wb").alias("w")), [*by, "w"]).groupBy(*by, "a", "b").agg(F.count("*").alias("common"))
    n = meet.join(a.select(*by, "a", F.size("wa").alias("na")), [*by, "a"]).join(b.select(*by, "b", F.size("wb").alias("nb")), [*by, "b"])
    cand = n.withColumn("s", F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).filter("s >= 0.05")
    return D.greedy_match(cand, by, "programme string, ay string, next_ay string, a string, b string, s double").withColumn("s", F.round("s", 6))


_LV = "MAP {" + ", ".join(f"'{v}': {k}" for v, k in rules.VERB_LEVEL.items()) + "}"
_SKIP = ", ".join(f"'{w}'" for w in rules.SKIP_WORDS.split())
_W5, _W7 = ("regexp_extract_all(lower(coalesce({0}, '')), '[a-z]+')[1:%d]" % n for n in (5, 7))
OUT = f"""{CTE}, lv AS (SELECT {_LV} AS m), o AS (SELECT id, family, unnest(outcomes) AS o FROM e), ot AS (SELECT id, family, o.text AS text, o.k_levels AS k FROM o),
b AS (SELECT id, family, text, k, list_filter({_W7.format('text')}, lambda w: w NOT IN ({_SKIP}) AND NOT ends_with(w, 'ly'))[1] AS verb, m[list_filter({_W5.format('text')}, lambda w: len(map_extract(m, w)) > 0)[1]] AS level FROM ot, lv),
b2 AS (SELECT id, family, text, k, verb, level FROM b)"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = enriched(spark, d).select("id", "family", F.explode("outcomes").alias("o")).select("id", "family", "o.text", F.col("o.k_levels").alias("k"))
    return o.withColumns({"verb": C.first_word(F.col("text")), "level": C.lexicon_level(F.col("text"))})


@query(f"WITH {OUT} SELECT level::INT AS level, count(*) AS n FROM b2 GROUP BY 1")
def blm_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).groupBy("level").agg(F.count("*").alias("n"))


@query(f"WITH {OUT} SELECT verb, count(*) AS n FROM b2 GROUP BY 1")
def blm_first_word(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).groupBy("verb").agg(F.count("*").alias("n"))


@query(f"WITH {OUT}, v AS (SELECT verb, k[1] AS l, count(*) AS n FROM b2 WHERE len(k) = 1 AND verb IS NOT NULL GROUP BY ALL), t AS (SELECT verb, l, n, sum(n) OVER (PARTITION BY verb) AS total FROM v QUALIFY row_number() OVER (PARTITION BY verb ORDER BY n DESC, l) = 1) SELECT verb, l::INT AS level, n, total::BIGINT AS total FROM t WHERE total >= 2")
def blm_verb_map(spark: SparkSession, d: str) -> DataFrame:
    """The level that an outcome's verb is tagged with most often (ties: the lower level), of verbs seen twice or more."""
    v = _outcomes(spark, d).filter("size(k) = 1 and verb is not null").groupBy("verb", F.get("k", F.lit(0)).alias("level")).agg(F.count("*").alias("n"))
    t = v.withColumn("total", F.sum("n").over(Window.partitionBy("verb"))).withColumn("r", F.row_number().over(Window.partitionBy("verb").orderBy(F.desc("n"), "level")))
    return t.filter("r = 1 and total >= 2").drop("r")


_TAGGED = "tg AS (SELECT family, k[1]::INT AS y, coalesce(level, 3)::INT AS p FROM b2 WHERE len(k) = 1)"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).filter("size(k) = 1").select("family", F.get("k", F.lit(0)).alias("y"), F.coalesce("level", F.lit(3)).alias("p"))


@query(f"WITH {OUT}, {_TAGGED} SELECT p AS level, count(*) AS n, round(avg((p = y)::INT), 6) AS precision FROM tg GROUP BY 1")
def blm_conf(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).groupBy(F.col("p").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") == F.col("y")).cast("double")), 6).alias("precision"))


@query(f"""WITH {OUT}, {_TAGGED}, yc AS (SELECT y AS k, count(*) AS t, count_if(y = p) AS tp FROM tg GROUP BY 1), pc AS (SELECT p AS k, count(*) AS s FROM tg GROUP BY 1)
SELECT count(*) AS n, round(avg((y = p)::INT), 6) AS accuracy, round(avg((abs(y - p) <= 1)::INT), 6) AS within_one, (SELECT round(avg(2 * tp / (t + coalesce(s, 0))), 6) FROM yc LEFT JOIN pc USING (k)) AS macro_f1 FROM tg""")
def evl_classification(spark: SparkSession, d: str) -> DataFrame:
    m = M.classification(_tagged(spark, d).withColumn("all", F.lit(1)), "y", "p", ["all"])
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "within_one", "macro_f1")))


@query(f"WITH {OUT}, {_TAGGED}, s AS (SELECT *, CASE WHEN ('0x' || substr(md5('42:' || family), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < 0.6 THEN 'train' ELSE 'rest' END AS part FROM tg) SELECT part, y AS level, count(*) AS n, round(avg((y = p)::INT), 6) AS accuracy FROM s GROUP BY GROUPING SETS ((part, y), (part), ())")
def evl_grouping(spark: SparkSession, d: str) -> DataFrame:
    t = _tagged(spark, d)
    s = K.split_by_rank(t).select("family", F.when(F.col("split") == "train", "train").otherwise("rest").alias("part"))
    x = t.join(s, "family")
    a = [F.count("*").alias("n"), F.round(F.avg((F.col("y") == F.col("p")).cast("double")), 6).alias("accuracy")]
    return x.rollup("part", F.col("y").alias("level")).agg(*a)


# label: does a document belong to the largest kinds; score: its length; group: its source
LAB = """d0 AS (SELECT DISTINCT doc_id, source, coalesce(length(text), 0)::DOUBLE AS s, (doc_kind = 'outline') AS y, CASE doc_kind WHEN 'outline' THEN 2 WHEN 'handbook' THEN 1 ELSE 0 END AS y3 FROM documents),
rk AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2 AS rs, rank() OVER (PARTITION BY source ORDER BY y3) + (count(*) OVER (PARTITION BY source, y3) - 1) / 2 AS ry FROM d0),
st0 AS (SELECT source, s, count_if(y) AS p, count(*) AS n FROM d0 GROUP BY ALL), cu AS (SELECT source, s, p, sum(p) OVER w AS tp, sum(n) OVER w AS predicted, sum(p) OVER (PARTITION BY source) AS positives FROM st0 WINDOW w AS (PARTITION BY source ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("doc_kind")
    return table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("s"), (kind == "outline").alias("y"), F.when(kind == "outline", 2).when(kind == "handbook", 1).otherwise(0).alias("y3")).distinct()


@query(f"WITH {LAB} SELECT source, CASE WHEN stddev_pop(ry) > 0 AND stddev_pop(rs) > 0 THEN round(corr(ry, rs), 6) END AS spearman FROM rk GROUP BY 1")
def evl_spearman(spark: SparkSession, d: str) -> DataFrame:
    return M.spearman(_labelled(spark, d), "y3", "s", ["source"]).withColumn("spearman", F.round("spearman", 6))


@query(f"WITH {LAB} SELECT source, CASE WHEN count_if(y) > 0 AND count_if(NOT y) > 0 THEN round((sum(rs) FILTER (WHERE y) - count_if(y) * (count_if(y) + 1) / 2) / (count_if(y) * count_if(NOT y)), 6) END AS auc FROM rk GROUP BY 1")
def evl_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(_labelled(spark, d), "y", "s", ["source"]).withColumn("auc", F.round("auc", 6))


@query(f"WITH {LAB} SELECT source, round(sum(tp / predicted * p / nullif(positives, 0)), 6) AS ap FROM cu GROUP BY 1")
def evl_ap(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(_labelled(spark, d), "y", "s", ["source"]).withColumn("ap", F.round("ap", 6))


@query(f"WITH {LAB}, f AS (SELECT source, s, 2 * tp / (predicted + positives) AS f1 FROM cu) SELECT source, s AS threshold, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(f1, 12) DESC, s) = 1")
def evl_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return M.best_threshold(_labelled(spark, d), "y", "s", ["source"]).withColumn("f1", F.round("f1", 6))


@query(f"WITH {LAB}, c AS (SELECT source, count_if(y AND s >= 1000)::BIGINT AS tp, count_if(NOT y AND s >= 1000)::BIGINT AS fp, count_if(y AND s < 1000)::BIGINT AS fn FROM d0 GROUP BY 1) SELECT source, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def evl_prf(spark: SparkSession, d: str) -> DataFrame:
    m = M.prf(_labelled(spark, d), "y", F.col("s") >= 1000, ["source"])
    return m.select("source", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {LAB}, x AS (SELECT y::INT AS y, s / (s + 1000) AS p FROM d0), b AS (SELECT least(floor(p * 5), 4) AS bin, count(*) AS n, sum((p - y) * (p - y)) AS sq, abs(avg(p) - avg(y)) AS gap FROM x GROUP BY 1) SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(gap * n) / sum(n), 6) AS ece FROM b")
def evl_calibration(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d).withColumn("p", F.col("s") / (F.col("s") + 1000))
    return M.calibration(x, "y", "p").select(F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


@query(f"WITH {LAB}, r AS (SELECT source, y, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS rn FROM d0), f AS (SELECT source, min(rn) FILTER (WHERE y) AS r FROM r GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr, round(avg(coalesce((r <= 1)::INT, 0)), 6) AS r1, round(avg(coalesce((r <= 5)::INT, 0)), 6) AS r5, round(avg(coalesce((r <= 10)::INT, 0)), 6) AS r10, round(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE / log2(r + 1) ELSE 0 END), 6) AS ndcg FROM f")
def evl_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = _labelled(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("s"), "doc_id")))
    m = M.rank_metrics(r.groupBy("source").agg(F.min(F.when(F.col("y"), F.col("rn"))).alias("r")), "r")
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("mrr", "r1", "r5", "r10", "ndcg")))


_EDGES = [round(x, 15) for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)]
_BOOT = f"""pg AS (SELECT source, sum(v)::DOUBLE AS s, count(v) AS c FROM bx GROUP BY 1), rp AS (SELECT rep, s, c, ('0x' || substr(md5('42:' || rep || ':' || source), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM pg, (SELECT unnest(range(1, 1001)) AS rep)),
rm AS (SELECT rep, sum(w * s) / nullif(sum(w * c), 0) AS m FROM (SELECT *, {' + '.join(f'(u >= {x})::INT' for x in _EDGES)} AS w FROM rp) GROUP BY 1), bo AS (SELECT (SELECT sum(s) / sum(c) FROM pg) AS value, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM rm)"""


@query(f"WITH {LAB}, bx AS (SELECT source, y::INT::DOUBLE AS v FROM d0 WHERE source IS NOT NULL), {_BOOT} SELECT round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high FROM bo")
def evl_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    b = M.bootstrap_mean(_labelled(spark, d).filter("source is not null").withColumn("v", F.col("y").cast("double")), "v", "source")
    return b.select(*(F.round(c, 6).alias(c) for c in ("value", "low", "high")))


@query(f"WITH {LAB}, bx AS (SELECT source, s / (s + 1000) - 0.5::DOUBLE AS v FROM d0 WHERE source IS NOT NULL), {_BOOT} SELECT round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > 0 THEN 'improved' WHEN high < 0 THEN 'worse' ELSE 'no clear difference' END AS verdict FROM bo")
def evl_paired(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d).filter("source is not null").select("source", F.lit(0.5).alias("base"), (F.col("s") / (F.col("s") + 1000)).alias("new"))
    return M.paired_difference(x, "base", "new", "source").select(*(F.round(c, 6).alias(c) for c in ("value", "low", "high")), "verdict")


def _vote(c: str) -> F.Column:
    v = F.regexp_replace(F.lower(F.col(c)), "[^a-z]", "")
    return F.when(v == "", None).when(F.lit("correct").startswith(v), "correct").when(F.lit("wrong").startswith(v), "wrong")


_V = "CASE WHEN regexp_replace(lower({0}), '[^a-z]', '', 'g') = '' THEN NULL WHEN starts_with('correct', regexp_replace(lower({0}), '[^a-z]', '', 'g')) THEN 'correct' WHEN starts_with('wrong', regexp_replace(lower({0}), '[^a-z]', '', 'g')) THEN 'wrong' END"
LBL = f"l AS (SELECT DISTINCT item, kind, {_V.format('pass1')} AS p1, {_V.format('pass2')} AS p2, {_V.format('pass3')} AS p3 FROM jdskills_llm), lc AS (SELECT *, CASE WHEN p1 = p2 OR p1 = p3 THEN p1 WHEN p2 = p3 THEN p2 END AS label FROM l)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "jdskills_llm").select("item", "kind", *(_vote(f"pass{i}").alias(f"p{i}") for i in (1, 2, 3))).distinct()
    return l.withColumn("label", F.when((F.col("p1") == F.col("p2")) | (F.col("p1") == F.col("p3")), F.col("p1")).when(F.col("p2") == F.col("p3"), F.col("p2")))


@query(f"WITH {LBL} SELECT item, label, CASE WHEN label IS NULL THEN 'uncertain' WHEN p1 = p2 THEN 'agreed' ELSE 'majority' END AS status FROM lc")
def lab_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("item", "label", F.when(F.col("label").isNull(), "uncertain").when(F.col("p1") == F.col("p2"), "agreed").otherwise("majority").alias("status"))


@query(f"WITH {LBL}, x AS (SELECT p1 AS a, p2 AS b FROM lc WHERE p1 IS NOT NULL AND p2 IS NOT NULL), n AS (SELECT count(*) AS n, count_if(a = b) AS same FROM x), e AS (SELECT sum((SELECT count(*) FROM x WHERE a = k) * (SELECT count(*) FROM x WHERE b = k)) AS e FROM (SELECT DISTINCT a AS k FROM x)) SELECT n, round(same / n, 6) AS agreement, round((same / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n, e")
def lab_kappa(spark: SparkSession, d: str) -> DataFrame:
    return M.kappa(_labels(spark, d), "p1", "p2").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(f"WITH {LBL} SELECT kind, count(*) AS n, count(label) AS labelled, round(avg(CASE WHEN label IS NOT NULL THEN (label = 'correct')::INT END), 6) AS precision FROM lc GROUP BY ROLLUP (kind)")
def lab_precision(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).rollup("kind").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.round(F.avg((F.col("label") == "correct").cast("double")), 6).alias("precision"))


@query(f"WITH {LBL} SELECT item FROM lc WHERE p1 IS NULL OR p1 IS DISTINCT FROM p2")
def lab_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).filter(F.col("p1").isNull() | ~F.col("p1").eqNullSafe(F.col("p2"))).select("item")


@query("WITH w AS (SELECT event_type, date_trunc('week', ts) AS wk FROM events), n AS (SELECT event_type, wk, count(*) / sum(count(*)) OVER (PARTITION BY wk) AS share, dense_rank() OVER (ORDER BY wk) AS r, dense_rank() OVER (ORDER BY wk DESC) AS rr FROM w GROUP BY event_type, wk) SELECT event_type, round(avg(share) FILTER (WHERE r <= 2), 6) AS early, round(avg(share) FILTER (WHERE rr <= 2), 6) AS late, round(avg(share) FILTER (WHERE rr <= 2) - avg(share) FILTER (WHERE r <= 2), 6) AS change FROM n GROUP BY 1")
def trd_share_change(spark: SparkSession, d: str) -> DataFrame:
    """Share of each event type in the two first and the two last weeks, and its change."""
    n = table(spark, d, "events").groupBy("event_type", F.date_trunc("week", "ts").alias("wk")).agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("wk")))
    weeks = n.select("wk").distinct()  # a row for each week
    one = Window.partitionBy(F.lit(0))
    weeks = weeks.withColumn("r", F.row_number().over(one.orderBy("wk"))).withColumn("rr", F.row_number().over(one.orderBy(F.desc("wk"))))
    x = n.join(F.broadcast(weeks), "wk")
    early, late = F.avg(F.when(F.col("r") <= 2, F.col("share"))), F.avg(F.when(F.col("rr") <= 2, F.col("share")))
    return x.groupBy("event_type").agg(F.round(early, 6).alias("early"), F.round(late, 6).alias("late"), F.round(late - early, 6).alias("change"))
