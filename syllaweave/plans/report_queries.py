"""Queries of the report tables: coverage, labels, fairness, targets, ranks and samples, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from syllaweave.functions import course as C
from syllaweave.operators import catalog as K, metrics as M, reports as R
from syllaweave.operators.lexical import STOP_WORDS
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


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS.split())
_H = "('0x' || substr(md5('42:' || family), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
_SPLIT = f"CASE WHEN {_H} < 0.6 THEN 'train' WHEN {_H} < 0.8 THEN 'val' ELSE 'test' END"


@query(f"""WITH {CTE}, x AS (SELECT *, {_SPLIT} AS split FROM e), p AS (SELECT split, unnest(programmes) AS p FROM x), pc AS (SELECT coalesce(split, 'all') AS part, count(DISTINCT p) AS programmes FROM p GROUP BY ROLLUP (split))
SELECT part, s.* EXCLUDE (part), programmes FROM (SELECT coalesce(split, 'all') AS part, count(*) AS versions, count(DISTINCT family) AS families, sum(coalesce(len(units), 0))::BIGINT AS units, sum(coalesce(len(outcomes), 0))::BIGINT AS outcomes, sum(coalesce(len(list_filter(outcomes, lambda o: len(o.k_levels) > 0)), 0))::BIGINT AS tagged FROM x GROUP BY ROLLUP (split)) s LEFT JOIN pc USING (part)""")
def cat_dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    e = enriched(spark, d)
    return R.dataset_statistics(e, K.split_by_rank(e))


@query(f"WITH {CTE}, p AS (SELECT family, id, lead(id) OVER (PARTITION BY family ORDER BY ay, id) AS next FROM e) SELECT p.id AS id_a, p.next AS id_b, a.course_name AS course_name_a, a.ay AS ay_a, b.course_name AS course_name_b, b.ay AS ay_b FROM p JOIN e a ON p.id = a.id JOIN e b ON p.next = b.id")
def lab_pair_ends(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive versions of a family with the names and years of both."""
    e = enriched(spark, d).select("family", "id", "ay", "course_name")
    p = e.select(F.col("id").alias("id_a"), F.lead("id").over(Window.partitionBy("family").orderBy("ay", "id")).alias("id_b")).filter("id_b is not null")
    return R.joined_ends(p, e, "id", ["course_name", "ay"]).select("id_a", "id_b", "course_name_a", "ay_a", "course_name_b", "ay_b")


@query(f"""WITH {CTE}, n AS (SELECT programme, ay, count(*) AS n FROM sn GROUP BY ALL), y AS (SELECT DISTINCT programme, ay FROM sn)
SELECT programme, ay FROM y LEFT JOIN n USING (programme, ay) QUALIFY row_number() OVER (PARTITION BY programme ORDER BY coalesce(n >= 10, false) DESC, ay DESC) = 1""")
def cat_default_year(spark: SparkSession, d: str) -> DataFrame:
    s = K.snapshot(enriched(spark, d).select("id", "ay", "family", "programmes"))
    return R.default_year(s, s.select("programme", "ay").distinct())


@query(f"WITH {CTE} SELECT family, arg_min(course_name, id) FILTER (WHERE course_name IS NOT NULL) AS course_name FROM e GROUP BY 1")
def cat_first_names(spark: SparkSession, d: str) -> DataFrame:
    """The name of a family's version with the least id."""
    return enriched(spark, d).filter("course_name is not null").groupBy("family").agg(F.min_by("course_name", "id").alias("course_name")).unionByName(
        enriched(spark, d).groupBy("family").agg(F.max("course_name").alias("course_name")).filter("course_name is null"))


@query(f"WITH {CTE} SELECT coalesce(nullif(regexp_extract(upper(c.code), '^[0-9]*([A-Z]{{2,4}})', 1), ''), 'OTHER') AS department, count(*) AS n FROM c GROUP BY 1")
def cat_departments(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).groupBy(C.department(F.col("code")).alias("department")).agg(F.count("*").alias("n"))


@query(f"WITH {CTE} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(course_name, '')), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))), ' ') AS tokens FROM c")
def txt_name_tokens(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("id", F.array_join(F.array_sort(C.name_tokens(F.col("course_name"))), " ").alias("tokens"))


# ---- ranks and samples --------------------------------------------------------------------------------------------------------------------


@query(f"WITH {S.LAB} SELECT doc_id, round((row_number() OVER (PARTITION BY source ORDER BY s, doc_id) - 1) / greatest(count(*) OVER (PARTITION BY source) - 1, 1), 6) AS pr, rank() OVER (PARTITION BY source ORDER BY s DESC) AS rank, rank() OVER (PARTITION BY source ORDER BY s DESC) + 0.5::DOUBLE * (count(*) OVER (PARTITION BY source, s) - 1) AS mean_rank FROM d0")
def smp_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Percentile rank, rank among better scores and tie-averaged rank of each document in its source."""
    x, by = S._labelled(spark, d), ["source"]
    return x.select("doc_id", F.round(R.percentile_rank(by, "s", "doc_id"), 6).alias("pr"), R.rank_among(by, "s").cast("bigint").alias("rank"), R.tie_averaged_rank(by, "s").alias("mean_rank"))


QUOTA = {"outline": 12, "handbook": 6, "job_description": 3}


@query("WITH d AS (SELECT DISTINCT doc_kind, doc_id FROM documents), q AS (SELECT *, row_number() OVER (PARTITION BY doc_kind ORDER BY md5('42:' || doc_id), doc_id) AS n FROM d) SELECT doc_kind, doc_id FROM q WHERE n <= CASE doc_kind WHEN 'outline' THEN 12 WHEN 'handbook' THEN 6 WHEN 'job_description' THEN 3 ELSE 0 END")
def smp_quotas(spark: SparkSession, d: str) -> DataFrame:
    """A quota for each stratum (a sampling operator)."""
    return R.quotas(table(spark, d, "documents").select("doc_kind", "doc_id").distinct(), "doc_kind", "doc_id", QUOTA)


@query("WITH d AS (SELECT DISTINCT doc_kind, doc_id FROM documents) SELECT doc_kind, stratum, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT *, (row_number() OVER (PARTITION BY doc_kind ORDER BY doc_id) - 1) % 4 AS stratum FROM d) GROUP BY ALL")
def smp_interleaved(spark: SparkSession, d: str) -> DataFrame:
    x = R.interleaved(table(spark, d, "documents").select("doc_kind", "doc_id").distinct(), "doc_kind", [F.col("doc_id")], 4)
    return x.groupBy("doc_kind", F.col("stratum").cast("bigint").alias("stratum")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {CTE}, o AS (SELECT family, unnest(outcomes).text AS text FROM e), t AS (SELECT DISTINCT family, text FROM o WHERE text IS NOT NULL) SELECT family, text FROM t QUALIFY row_number() OVER (PARTITION BY family ORDER BY md5(text), text) <= 8")
def smp_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Up to eight outcome statements of each family in the order of their hash (a sampling operator)."""
    o = enriched(spark, d).select("family", F.explode("outcomes.text").alias("text")).filter("text is not null").distinct()
    return o.withColumn("n", F.row_number().over(Window.partitionBy("family").orderBy(F.md5("text"), "text"))).filter("n <= 8").drop("n")


@query(f"WITH {CTE} SELECT family, id FROM e QUALIFY row_number() OVER (PARTITION BY family ORDER BY ay DESC, id) <= 2")
def smp_two_offerings(spark: SparkSession, d: str) -> DataFrame:
    """At most two offerings of a course, the newest first (the selection rule of the catalogue reader)."""
    w = Window.partitionBy("family").orderBy(F.desc("ay"), "id")
    return enriched(spark, d).select("family", "ay", "id").withColumn("n", F.row_number().over(w)).filter("n <= 2").select("family", "id")


@query(f"WITH {S.LAB}, r AS (SELECT source, y, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS rn FROM d0) SELECT source, coalesce(min(rn) FILTER (WHERE y AND rn <= 300), 1000000) AS rank FROM r GROUP BY 1")
def evl_first_relevant(spark: SparkSession, d: str) -> DataFrame:
    return R.first_relevant(S._labelled(spark, d), "source", "s", "doc_id", F.col("y")).withColumn("rank", F.col("rank").cast("bigint"))


# ---- labels -------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {S.OUT}, {S._TAGGED} SELECT y AS level, count(*) AS n FROM tg GROUP BY 1 ORDER BY n DESC, y LIMIT 1")
def evl_majority(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent level (ties: the lower one)."""
    n = S._tagged(spark, d).groupBy(F.col("y").alias("level")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "level").limit(1)


_KAPPA = """cc AS (SELECT y AS a, p AS b, count(*) AS c FROM tg GROUP BY ALL), ra AS (SELECT a, sum(c) AS ca FROM cc GROUP BY 1), rb AS (SELECT b, sum(c) AS cb FROM cc GROUP BY 1),
k AS (SELECT w.power, (SELECT sum(c) FROM cc)::BIGINT AS n, (SELECT sum(abs(a - b) ** w.power * c) FROM cc) AS o, (SELECT sum(abs(a - b) ** w.power * ca * cb) FROM ra, rb) AS e FROM (SELECT unnest([1, 2]) AS power) w)"""


@query(f"WITH {S.OUT}, {S._TAGGED}, {_KAPPA} SELECT power, n, round(1 - o * n / e, 6) AS kappa FROM k")
def lab_kappa_weighted(spark: SparkSession, d: str) -> DataFrame:
    t = S._tagged(spark, d)
    out = [R.weighted_kappa(t, "y", "p", k).select(F.lit(k).alias("power"), "n", F.round("kappa", 6).alias("kappa")) for k in (1, 2)]
    return out[0].unionByName(out[1])


_DEMAND = "CASE WHEN lower(trim(coalesce(demanded, ''))) IN ('', 'no', 'false', '0', 'n') THEN 'not demanded' ELSE 'demanded' END"


def _demanded() -> F.Column:
    return F.when(F.lower(F.trim(F.coalesce("demanded", F.lit("")))).isin("", "no", "false", "0", "n"), "not demanded").otherwise("demanded")


_LD = f"{S.LBL}, dm AS (SELECT DISTINCT item, kind, theme, {_DEMAND} AS scope FROM jdskills_llm), ld AS (SELECT DISTINCT item, kind, theme, scope, label FROM dm JOIN (SELECT item, kind, label FROM lc) USING (item, kind))"


def _label_scopes(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jdskills_llm").select("item", "kind", "theme", _demanded().alias("scope")).distinct()
    return j.join(S._labels(spark, d).select("item", "kind", "label"), ["item", "kind"]).distinct()


@query(f"WITH {_LD} SELECT kind, scope, count(*) AS n, count_if(label IS NULL)::BIGINT AS uncertain, round(avg(CASE WHEN label IS NOT NULL THEN (label = 'correct')::INT END), 6) AS precision FROM ld GROUP BY ALL")
def lab_flag_precision(spark: SparkSession, d: str) -> DataFrame:
    """Precision of flags by kind and scope; uncertain ones don't count."""
    return _label_scopes(spark, d).groupBy("kind", "scope").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("uncertain"), F.round(F.avg((F.col("label") == "correct").cast("double")), 6).alias("precision"))


@query(f"WITH {_LD}, x AS (SELECT kind, 'all' AS scope, label FROM ld UNION ALL SELECT kind, scope, label FROM ld WHERE scope = 'demanded') SELECT scope, kind, count(*) AS n, round(avg(CASE WHEN label IS NOT NULL THEN (label = 'correct')::INT END), 6) AS precision FROM x GROUP BY GROUPING SETS ((scope, kind), (scope))")
def lab_coverage_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Precision over all items and over the demanded ones, by kind and together: one pass, as a row counts for its scopes."""
    x = _label_scopes(spark, d).select("kind", "label", F.explode(F.when(F.col("scope") == "demanded", F.array(F.lit("all"), F.lit("demanded"))).otherwise(F.array(F.lit("all")))).alias("scope"))
    return x.groupingSets([["scope", "kind"], ["scope"]], "scope", "kind").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == "correct").cast("double")), 6).alias("precision"))


@query(f"WITH {_LD}, t AS (SELECT theme, count(DISTINCT item) AS n_items, count(DISTINCT kind) AS n_kinds, array_to_string(list_sort(list(DISTINCT kind)), ';') AS kinds FROM ld WHERE theme IS NOT NULL GROUP BY 1) SELECT theme, n_items, n_kinds, kinds, row_number() OVER (ORDER BY n_kinds DESC, n_items DESC, lower(theme), theme) AS place FROM t")
def mod_theme_table(spark: SparkSession, d: str) -> DataFrame:
    """Themes with their distinct phrases and kinds, the widest first (a row for each theme)."""
    t = _label_scopes(spark, d).filter("theme is not null").groupBy("theme").agg(F.count_distinct("item").alias("n_items"), F.count_distinct("kind").alias("n_kinds"), F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n_kinds"), F.desc("n_items"), F.lower("theme"), "theme")
    return t.withColumn("place", F.row_number().over(w).cast("bigint"))


@query(f"""WITH {S.OUT}, {S._TAGGED}, {S.LBL}, u AS (SELECT 'skills' AS source, coalesce(label, 'uncertain') AS label FROM lc UNION ALL SELECT 'outcomes', y::VARCHAR FROM tg) SELECT *, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, label, count(*) AS n FROM u GROUP BY ALL)""")
def lab_summary(spark: SparkSession, d: str) -> DataFrame:
    """How often each label stands in each label table."""
    u = S._labels(spark, d).select(F.lit("skills").alias("source"), F.coalesce("label", F.lit("uncertain")).alias("label")).unionByName(S._tagged(spark, d).select(F.lit("outcomes").alias("source"), F.col("y").cast("string").alias("label")))
    n = u.groupBy("source", "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query(f"""WITH {CTE}, k AS (SELECT regexp_replace(replace(lower(canonical_name), '&', 'and'), '[^a-z0-9]+', '', 'g') AS k, min(department) AS department FROM course_catalog GROUP BY 1)
SELECT id, coalesce(department, 'none') AS department, department IS NOT NULL AS reused FROM c LEFT JOIN k ON coalesce(regexp_replace(replace(lower(course_name), '&', 'and'), '[^a-z0-9]+', '', 'g'), '') = k.k""")
def lab_reuse(spark: SparkSession, d: str) -> DataFrame:
    """A label known for an equal name is used again, others get a default."""
    k = table(spark, d, "course_catalog").select(F.col("canonical_name").alias("course_name"), "department")
    return R.reuse_labels(versions(spark, d).select("id", "course_name"), k, ["course_name"], "department", "none").select("id", "department", "reused")


@query("SELECT DISTINCT topic, coalesce(nullif(trim(note), ''), 'no note') AS note FROM emerging_topics")
def lab_notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "emerging_topics").select("topic", F.coalesce(F.nullif(F.trim("note"), F.lit("")), F.lit("no note")).alias("note")).distinct()


@query(f"WITH {_LD} SELECT 'JS' || lpad(row_number() OVER (ORDER BY kind, item, theme, scope)::VARCHAR, 6, '0') AS id, kind, item FROM ld")
def lab_item_ids(spark: SparkSession, d: str) -> DataFrame:
    """Items numbered in order, from ranges of their keys and offsets, so no task sees them all."""
    from syllaweave.sources.files import numbered

    x = _label_scopes(spark, d).select("kind", "item", "theme", "scope")
    return numbered(x, ["kind", "item", "theme", "scope"], "n").select(F.concat(F.lit("JS"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("id"), "kind", "item")


# ---- outcome levels -----------------------------------------------------------------------------------------------------------------------

_FP = "fp AS (SELECT family, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE ['COMMON'] END) AS programme FROM (SELECT family, list_distinct(flatten(list(programmes))) AS ps FROM e GROUP BY 1)), bp2 AS (SELECT programme, count(*) AS n, avg((y = p)::INT) AS accuracy FROM tg JOIN fp USING (family) GROUP BY 1)"


def _by_programme(spark: SparkSession, d: str) -> DataFrame:
    p = enriched(spark, d).groupBy("family").agg(F.array_distinct(F.flatten(F.collect_set("programmes"))).alias("programmes"))
    return R.accuracy_by_programme(S._tagged(spark, d), p, "family", F.col("p") == F.col("y"))


@query(f"WITH {S.OUT}, {S._TAGGED}, {_FP} SELECT programme, n, round(accuracy, 6) AS accuracy FROM bp2")
def evl_by_programme(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of outcome levels by programme; a statement counts for every programme of its family."""
    return _by_programme(spark, d).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {S.OUT}, {S._TAGGED}, {_FP}, r AS (SELECT programme, n, round(accuracy, 9) AS a FROM bp2) SELECT arg_min(programme, (a, programme)) FILTER (WHERE n >= 20) AS lowest, min(a) FILTER (WHERE n >= 20) AS low, arg_max(programme, (a, programme)) FILTER (WHERE n >= 20) AS highest, max(a) FILTER (WHERE n >= 20) AS high, coalesce(array_to_string(list_sort(list(programme) FILTER (WHERE n < 20)), ';'), '') AS excluded FROM r")
def evl_fairness(spark: SparkSession, d: str) -> DataFrame:
    return R.fairness(_by_programme(spark, d), 20)


@query(f"""WITH {S.OUT}, {S._TAGGED}, v AS (SELECT 'accuracy' AS metric, avg((y = p)::INT) AS value FROM tg UNION ALL SELECT 'within one', avg((abs(y - p) <= 1)::INT) FROM tg), t(metric, op, target) AS (VALUES ('accuracy', '>=', 0.5::DOUBLE), ('within one', '>=', 0.99::DOUBLE), ('ece', '<=', 0.1::DOUBLE))
SELECT metric, round(value, 6) AS value, op, target, CASE WHEN value IS NULL THEN 'n/a' WHEN CASE WHEN op = '>=' THEN value >= target ELSE value <= target END THEN 'yes' ELSE 'no' END AS met FROM t LEFT JOIN v USING (metric)""")
def evl_targets(spark: SparkSession, d: str) -> DataFrame:
    t = S._tagged(spark, d)
    m = t.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"), F.avg((F.abs(F.col("y") - F.col("p")) <= 1).cast("double")).alias("within one"))
    values = m.unpivot([], ["accuracy", "within one"], "metric", "value")
    targets = spark.createDataFrame([("accuracy", ">=", 0.5), ("within one", ">=", 0.99), ("ece", "<=", 0.1)], "metric string, op string, target double")
    return R.against_targets(values, targets).withColumn("value", F.round("value", 6))


@query(f"""WITH {S.OUT}, {S._TAGGED}, mc AS (SELECT count_if(p = y AND y <> 3)::BIGINT AS b, count_if(p <> y AND y = 3)::BIGINT AS c FROM tg)
SELECT b, c, round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) FROM (SELECT unnest(range(0, least(b, c) + 1)) AS k))), 6) AS p FROM mc""")
def evl_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Exact paired test of the lexicon against the constant third level: cases that only one of them gets right."""
    right, base = F.col("p") == F.col("y"), F.col("y") == 3
    n = S._tagged(spark, d).agg(F.count_if(right & ~base).alias("b"), F.count_if(~right & base).alias("c"))
    return n.select("b", "c", F.round(R.binomial_two_sided(F.col("b"), F.col("c")), 6).alias("p"))


@query(f"""WITH {S.OUT}, m AS (SELECT list_sort(list_distinct(k)) AS t, CASE WHEN level IS NULL THEN [3] ELSE [level] END AS p FROM b2 WHERE len(k) > 0),
x AS (SELECT t, p, len(list_intersect(t, p)) AS tp FROM m), l AS (SELECT l, 2 * count_if(list_contains(t, l) AND list_contains(p, l)) / (count_if(list_contains(t, l)) + count_if(list_contains(p, l))) AS f1 FROM x, (SELECT unnest(range(1, 7))::INT AS l) WHERE list_contains(t, l) OR list_contains(p, l) GROUP BY 1)
SELECT count(*) AS n, round(2 * sum(tp) / sum(len(t) + len(p)), 6) AS micro_f1, (SELECT round(avg(f1), 6) FROM l) AS macro_f1, round(avg(2 * tp / (len(t) + len(p))), 6) AS sample_f1, round(sum(len(t) + len(p) - 2 * tp) / (count(*) * 6), 6) AS hamming FROM x""")
def evl_multilabel(spark: SparkSession, d: str) -> DataFrame:
    o = S._outcomes(spark, d).filter("size(k) > 0").select("k", F.array(F.coalesce("level", F.lit(3))).alias("p"))
    m = R.multilabel(o, "k", "p", 6)
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("micro_f1", "macro_f1", "sample_f1", "hamming")))


@query(f"""WITH {S.OUT}, {S._TAGGED.replace('SELECT family,', 'SELECT id, text, family,')}, s AS (SELECT *, {_SPLIT} AS split FROM tg) SELECT split, count(*) AS n, sum(y)::BIGINT AS levels FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY text ORDER BY list_position(['train', 'val', 'test'], split), id, y) = 1) GROUP BY 1""")
def blm_deleaked(spark: SparkSession, d: str) -> DataFrame:
    """Tagged statements of each split; a text that the training split has is left out of the others."""
    o = S._outcomes(spark, d).filter("size(k) = 1").select("id", "family", "text", F.get("k", F.lit(0)).alias("y"))
    x = o.join(K.split_by_rank(enriched(spark, d)), "family").withColumn("key", F.struct("id", "y"))
    return R.without_leaks(x, "text", "split", ["train", "val", "test"], "key").groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("levels"))


@query(f"""WITH {S.OUT}, o3 AS (SELECT DISTINCT text, k[1]::INT AS y, coalesce(level, 3)::INT AS p FROM b2 WHERE len(k) = 1), w AS (SELECT CASE WHEN p > y THEN 'too high' ELSE 'too low' END AS kind, text, y, p, abs(p - y) AS gap FROM o3 WHERE p <> y)
SELECT kind, text, y, p, row_number() OVER (PARTITION BY kind ORDER BY gap DESC, text, y) AS place FROM w QUALIFY place <= CASE kind WHEN 'too high' THEN 3 ELSE 2 END""")
def evl_failures(spark: SparkSession, d: str) -> DataFrame:
    """The worst outcome levels of either kind (a top-k report)."""
    o = S._outcomes(spark, d).filter("size(k) = 1").select("text", F.get("k", F.lit(0)).alias("y"), F.coalesce("level", F.lit(3)).alias("p")).distinct().filter("p <> y")
    x = o.withColumn("kind", F.when(F.col("p") > F.col("y"), "too high").otherwise("too low")).withColumn("key", F.struct("text", "y"))
    return R.worst(x, "kind", F.abs(F.col("p") - F.col("y")), "key", {"too high": 3, "too low": 2}).select("kind", "text", "y", "p", F.col("place").cast("bigint").alias("place"))


# ---- thresholds ---------------------------------------------------------------------------------------------------------------------------

_G30 = [round(0.05 + 0.92 * i / 29, 6) for i in range(30)]


@query(f"WITH {S.LAB}, t AS (SELECT DISTINCT unnest(quantile_cont(s, {_G30})) AS tau FROM d0), g AS (SELECT tau, count_if(y AND s >= tau) AS tp, count_if(s >= tau) AS pr, count_if(y) AS pos FROM d0, t GROUP BY 1) SELECT round(tau, 6) AS tau, round(2 * tp / nullif(pr + pos, 0), 6) AS f1, row_number() OVER (ORDER BY round(2 * tp / nullif(pr + pos, 0), 12) DESC, tau) = 1 AS best FROM g")
def evl_quantile_grid(spark: SparkSession, d: str) -> DataFrame:
    """F1 at thirty quantiles of the score, and which is best (ties: the smallest)."""
    from syllaweave.operators.evaluation import threshold_grid

    x = S._labelled(spark, d)
    taus = x.agg(F.percentile("s", F.array(*map(F.lit, _G30)))).first()[0]  # thirty numbers
    g = threshold_grid(x, "s", F.col("y"), ~F.col("y"), taus)
    n = x.agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    f1 = 2 * F.col("recall") * F.col("pos") / (F.col("recall") * F.col("pos") + F.col("false_alarm") * F.col("neg") + F.col("pos"))
    g = g.crossJoin(F.broadcast(n)).withColumn("f1", f1)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("f1", 12)), "tau")  # thirty rows
    return g.select(F.round("tau", 6).alias("tau"), F.round("f1", 6).alias("f1"), (F.row_number().over(w) == 1).alias("best"))


@query(f"""WITH {S.LAB}, h AS (SELECT *, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 5 < 3 AS train FROM d0), st1 AS (SELECT s, count_if(y) AS p, count(*) AS n FROM h WHERE train GROUP BY 1), cu1 AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS pr, sum(p) OVER () AS pos FROM st1 WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT s AS tau FROM cu1 ORDER BY round(2 * tp / (pr + pos), 12) DESC, s LIMIT 1), c AS (SELECT tau, count_if(y AND s >= tau)::BIGINT AS tp, count_if(NOT y AND s >= tau)::BIGINT AS fp, count_if(y AND s < tau)::BIGINT AS fn FROM h, b WHERE NOT train GROUP BY 1)
SELECT tau, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def evl_train_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of the best F1 on three fifths of the rows, measured on the others."""
    x = S._labelled(spark, d).withColumns({"all": F.lit(1), "train": F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("bigint") % 5 < 3})
    best = M.best_threshold(x.filter("train"), "y", "s", ["all"]).select("threshold")
    m = M.prf(x.filter("not train").crossJoin(F.broadcast(best)), "y", F.col("s") >= F.col("threshold"), ["threshold"])  # one row
    return m.select(F.col("threshold").alias("tau"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND ('0x' || substr(md5(a.vec_id || ':' || b.vec_id), 1, 8))::BIGINT % 4 = 0) SELECT count(*) AS n, round(quantile_cont(s, 0.99), 6) AS tau FROM p")
def evl_calibrated_tau(spark: SparkSession, d: str) -> DataFrame:
    """The 99 % quantile of the similarity of a hashed quarter of the pairs of one label (a sampling operator)."""
    from syllaweave.operators.vectors import unit_pairs

    v = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("g"), F.col("vec_id").alias("u"), F.col("embedding").alias("v"))
    p = unit_pairs(v.withColumn("o", F.col("u")), "g", "o", "u", "v", -2.0)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "ix_a", "ix_b")), 1, 8), 16, 10).cast("bigint")
    return p.filter(h % 4 == 0).agg(F.count("*").alias("n"), F.round(F.percentile("sim", 0.99), 6).alias("tau"))


@query(f"WITH {S.LAB} SELECT source, array_to_string(list_sort(list(DISTINCT round(s, 6)))[1:5], ';') AS lowest, count(DISTINCT s) AS n FROM d0 WHERE y GROUP BY 1")
def ov_fusion_reference(spark: SparkSession, d: str) -> DataFrame:
    """The sorted scores of labelled rows that later scores are placed among: their number and the five lowest."""
    x = S._labelled(spark, d).filter("y").select("source", F.round("s", 6).alias("s")).distinct()
    r = x.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("s")))
    low = F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.col("s"))))
    return r.groupBy("source").agg(F.array_join(F.transform(low, lambda v: v.cast("string")), ";").alias("lowest"), F.count("*").alias("n"))


@query(f"WITH {S.LAB} SELECT source, CASE WHEN count_if(y) >= 8 AND count_if(NOT y) >= 8 THEN 'yes' ELSE 'no' END AS judged, printf('%.0f%%', round_even(100.0 * avg(y::INT), 0)) AS share, format('{{:,}}', sum(s)::BIGINT) AS chars FROM d0 GROUP BY 1")
def txt_formatted(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as a report prints them: whole percentages, thousands separators."""
    x = S._labelled(spark, d)
    y = F.col("y")
    return x.groupBy("source").agg(F.when((F.count_if(y) >= 8) & (F.count_if(~y) >= 8), "yes").otherwise("no").alias("judged"), R.as_percent(F.avg(y.cast("double"))).alias("share"), R.formatted(F.sum("s"), 0).alias("chars"))


# ---- prerequisites ------------------------------------------------------------------------------------------------------------------------


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of the first rule set against the packed values of the same field."""
    from syllaweave.functions.text import squeezed

    v = versions(spark, d)
    said = F.transform(F.filter(F.split(F.coalesce("prerequisites", F.lit("")), "[,;]"), lambda x: F.trim(x) != ""), squeezed)
    return v.select("id", "ay" if "ay" in v.columns else F.lit("").alias("ay"), F.array_distinct(said).alias("gold"), C.split_prerequisites(F.col("prerequisites")).alias("said"))


_GOLD = f"""gx AS (SELECT id, list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce(prerequisites, ''), '[,;]'), lambda x: trim(x) <> ''), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS gold, regexp_replace(coalesce(prerequisites, ''), '\\(([^)]*\\d[^)]*)\\)', ' ', 'g') AS t FROM c),
g0 AS (SELECT id, gold, list_distinct({S._SPLIT1}) AS said FROM gx), ga AS (SELECT id, unnest(gold) AS a FROM g0), gb AS (SELECT id, unnest(said) AS b FROM g0),
gw AS (SELECT id, a, b, list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')) AS wa, list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')) AS wb FROM ga JOIN gb USING (id)),
gs AS (SELECT id, a, b, round(len(list_intersect(wa, wb)) / greatest(1, len(list_distinct(list_concat(wa, wb)))), 9) AS s FROM gw), gc AS (SELECT id, a, b, row_number() OVER (PARTITION BY id ORDER BY s DESC, a DESC, b DESC) AS k FROM gs WHERE s >= 0.5),
gr AS (SELECT id, 0::BIGINT AS k, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub FROM g0 UNION ALL SELECT gr.id, gc.k, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END FROM gr JOIN gc ON gc.id = gr.id AND gc.k = gr.k + 1),
gt AS (SELECT id, max(len(ua)) AS tp FROM gr GROUP BY 1), gm AS (SELECT g0.id, len(gold) AS n_gold, len(said) AS n_said, tp FROM g0 JOIN gt USING (id))"""


@query(f"WITH RECURSIVE {CTE}, {_GOLD} SELECT id, n_gold, n_said, tp FROM gm")
def pre_phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """Phrases split at commas against the first rule set: greedy one-to-one matches of half their words or more."""
    return _gold(spark, d).select("id", F.size("gold").cast("bigint").alias("n_gold"), F.size("said").cast("bigint").alias("n_said"), R.greedy_tp(F.col("gold"), F.col("said"), 0.5).cast("bigint").alias("tp"))


@query(f"""WITH RECURSIVE {CTE}, {_GOLD}, k AS (SELECT *, CASE WHEN n_gold = 0 THEN 'none' WHEN n_gold = 1 THEN 'single' ELSE 'several' END AS kind FROM gm)
SELECT kind, count(*) AS n, round(sum(tp) / nullif(sum(n_said), 0), 6) AS precision, round(sum(tp) / nullif(sum(n_gold), 0), 6) AS recall, round(2 * sum(tp) / nullif(sum(n_said) + sum(n_gold), 0), 6) AS f1, round(avg(CASE WHEN n_gold = 0 THEN (n_said > 0)::INT END), 6) AS false_alarm FROM k GROUP BY ROLLUP (kind)""")
def pre_extraction_score(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and micro F1 of phrase extraction by kind of field and over all, and false alarms on empty fields."""
    m = pre_phrase_match(spark, d).withColumn("kind", F.when(F.col("n_gold") == 0, "none").when(F.col("n_gold") == 1, "single").otherwise("several"))
    tp, said, gold = (F.sum(c) for c in ("tp", "n_said", "n_gold"))
    safe = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return m.rollup("kind").agg(F.count("*").alias("n"), safe(tp, said).alias("precision"), safe(tp, gold).alias("recall"), safe(2 * tp, said + gold).alias("f1"), F.round(F.avg(F.when(F.col("n_gold") == 0, (F.col("n_said") > 0).cast("double"))), 6).alias("false_alarm"))


@query(f"""WITH {CTE}, x AS (SELECT id, regexp_replace(coalesce(prerequisites, ''), '\\(([^)]*\\d[^)]*)\\)', ' ', 'g') AS t FROM c), p AS (SELECT DISTINCT id, unnest({S._SPLIT1}) AS phrase FROM x), k AS (SELECT id, phrase, regexp_replace(replace(lower(phrase), '&', 'and'), '[^a-z0-9]+', '', 'g') AS k FROM p)
SELECT a.id, a.phrase AS phrase_a, b.phrase AS phrase_b FROM k a JOIN k b ON a.id = b.id AND a.phrase < b.phrase AND a.k <> '' AND b.k <> '' AND (contains(a.k, b.k) OR contains(b.k, a.k))""")
def pre_same_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of one field that mean the same: the key of one holds that of the other."""
    p = versions(spark, d).select("id", C.split_prerequisites(F.col("prerequisites")).alias("ps"))
    pairs = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", lambda b: (a < b) & C.same_phrase(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return p.select("id", F.explode(pairs).alias("x")).select("id", F.col("x.a").alias("phrase_a"), F.col("x.b").alias("phrase_b"))


@query(f"""WITH {S.PRE}, n AS (SELECT programme, regexp_replace(replace(lower(course_name), '&', 'and'), '[^a-z0-9]+', '', 'g') AS k, min(sem) AS first_sem FROM bp WHERE sem IS NOT NULL AND sem >= 1 GROUP BY ALL)
SELECT pk.programme, pk.family, pk.sem, pk.phrase, n.first_sem, n.first_sem < pk.sem AS in_order FROM pk LEFT JOIN n ON n.programme = pk.programme AND n.k = pk.k""")
def pre_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The first semester of a course with the phrase's name in the programme, and whether it comes before (NULL if unknown)."""
    from syllaweave.functions.text import reduced

    e, _, covered, _ = S._schedule(spark, d)
    named = K.by_programme(e.select("programmes", "common", "sem", "course_name")).filter("sem >= 1").groupBy("programme", reduced(F.col("course_name")).alias("phrase_key")).agg(F.min("sem").alias("first_sem"))
    ph = S._phrases(e, covered).select("programme", "family", "sem", "phrase", "phrase_key").distinct()
    return ph.join(named, ["programme", "phrase_key"], "left").select("programme", "family", "sem", "phrase", "first_sem", (F.col("first_sem") < F.col("sem")).alias("in_order"))


_FLAGS = f"""{S.PRE}, r AS (SELECT pk.*, nm.resolved_family, er.first_sem FROM pk LEFT JOIN nm ON pk.k = nm.k LEFT JOIN er ON er.programme = pk.programme AND er.family = nm.resolved_family WHERE nm.resolved_family IS NULL OR nm.resolved_family <> pk.family),
fl AS (SELECT programme, family, sem, phrase, resolved_family, CASE WHEN resolved_family IS NULL THEN 'unresolved' ELSE 'not_offered_earlier' END AS type FROM r WHERE resolved_family IS NULL OR first_sem IS NULL OR first_sem >= sem)"""


@query(f"WITH {_FLAGS} SELECT programme, type, count(*) AS n, count(DISTINCT family) AS n_families FROM fl GROUP BY GROUPING SETS ((programme, type), (type), ())")
def pre_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    f = S.pre_flags(spark, d)
    return f.groupingSets([["programme", "type"], ["type"], []], "programme", "type").agg(F.count("*").alias("n"), F.count_distinct("family").alias("n_families"))


@query(f"""WITH {_FLAGS}, i AS (SELECT DISTINCT 'prerequisite' AS detector, programme || '|' || family || '|' || phrase AS text FROM fl UNION ALL SELECT DISTINCT 'level', text FROM (SELECT unnest(outcomes).text AS text FROM e) WHERE length(text) < 25 UNION ALL SELECT DISTINCT 'name', course_name FROM e WHERE length(trim(course_name)) <= 4)
SELECT 'FL' || lpad(row_number() OVER (ORDER BY detector, text)::VARCHAR, 6, '0') AS item, detector, text FROM i""")
def lab_flag_items(spark: SparkSession, d: str) -> DataFrame:
    """What several detectors found as one numbered list for annotators, without scores."""
    from syllaweave.sources.files import numbered

    e = enriched(spark, d)
    f = S.pre_flags(spark, d).select(F.lit("prerequisite").alias("detector"), F.concat_ws("|", "programme", "family", "phrase").alias("text")).distinct()
    o = e.select(F.lit("level").alias("detector"), F.explode("outcomes.text").alias("text")).filter("length(text) < 25").distinct()
    n = e.select(F.lit("name").alias("detector"), F.col("course_name").alias("text")).filter("length(trim(text)) <= 4").distinct()
    return numbered(f.unionByName(o).unionByName(n), ["detector", "text"], "n").select(F.concat(F.lit("FL"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("item"), "detector", "text")


@query(f"""WITH {_FLAGS}, h AS (SELECT DISTINCT programme, family, phrase, ('0x' || substr(md5(programme || family || phrase), 1, 8))::BIGINT % 3 = 0 AS confirmed FROM fl), x AS (SELECT h.*, regexp_replace(replace(lower(phrase), '&', 'and'), '[^a-z0-9]+', '', 'g') AS k FROM h),
v AS (SELECT DISTINCT programme, family, phrase, regexp_replace(replace(lower(phrase), '&', 'and'), '[^a-z0-9]+', '', 'g') AS k FROM fl WHERE type = 'unresolved'),
j AS (SELECT x.*, EXISTS (SELECT 1 FROM v WHERE v.programme = x.programme AND v.family = x.family AND v.k <> '' AND x.k <> '' AND (contains(v.k, x.k) OR contains(x.k, v.k))) AS kept FROM x)
SELECT confirmed, kept, count(*) AS n FROM j GROUP BY ALL""")
def pre_same_label_eval(spark: SparkSession, d: str) -> DataFrame:
    """Labelled flags (a hash stands for the label) that a narrower checker still raises, matched by phrase meaning."""
    f = S.pre_flags(spark, d)
    label = F.conv(F.substring(F.md5(F.concat("programme", "family", "phrase")), 1, 8), 16, 10).cast("bigint") % 3 == 0
    x = f.select("programme", "family", "phrase").distinct().withColumn("confirmed", label)
    v = f.filter("type = 'unresolved'").select("programme", "family", F.col("phrase").alias("other")).distinct()
    hit = x.join(v, ["programme", "family"]).filter(C.same_phrase(F.col("phrase"), F.col("other"))).select("programme", "family", "phrase").distinct().withColumn("kept", F.lit(True))
    return x.join(hit, ["programme", "family", "phrase"], "left").groupBy("confirmed", F.coalesce("kept", F.lit(False)).alias("kept")).agg(F.count("*").alias("n"))


@query(f"""WITH {S.PRE}, n AS (SELECT family, arg_min(regexp_replace(replace(lower(course_name), '&', 'and'), '[^a-z0-9]+', '', 'g'), id) AS name FROM e GROUP BY 1 HAVING length(name) >= 5),
x AS (SELECT pk.programme, pk.family, pk.sem, pk.phrase, pk.k, n.family AS hit, n.name FROM pk JOIN n ON length(k) >= 5 AND (contains(name, k) OR contains(k, name)) JOIN er ON er.programme = pk.programme AND er.family = n.family AND er.first_sem < pk.sem WHERE n.family <> pk.family),
cs AS (SELECT programme, family, sem, phrase, k, min(hit) AS removed, min(name) AS name FROM x GROUP BY ALL HAVING count(DISTINCT hit) = 1)
SELECT count(*) AS cases, round(avg((k <> 'principlesof' || name)::INT), 6) AS exact_alarm, round(avg((NOT (contains('principlesof' || name, k) OR contains(k, 'principlesof' || name)))::INT), 6) AS contained_alarm FROM cs""")
def pre_rename_test(spark: SparkSession, d: str) -> DataFrame:
    """Every removal case with its course renamed to "Principles of ...": the share that exact names and that contained names then miss."""
    from syllaweave.functions.text import reduced
    from syllaweave.operators import prerequisites as P

    e, _, covered, first = S._schedule(spark, d)
    ph = S._phrases(e, covered)
    names = e.groupBy(F.col("family").alias("removed_family")).agg(F.concat(F.lit("principlesof"), F.min_by(reduced(F.col("course_name")), "id")).alias("renamed"))
    c = P.removal_cases(ph, e, first).join(ph.select("phrase", "phrase_key").distinct(), "phrase").join(names, "removed_family")
    contained = F.contains("renamed", "phrase_key") | F.contains("phrase_key", "renamed")
    return c.agg(F.count("*").alias("cases"), F.round(F.avg((F.col("phrase_key") != F.col("renamed")).cast("double")), 6).alias("exact_alarm"), F.round(F.avg((~contained).cast("double")), 6).alias("contained_alarm"))


@query("WITH x AS (SELECT DISTINCT item, split, coalesce(nullif(trim(method), ''), 'unknown') AS method FROM course_membership), m AS (SELECT item, lower(trim(split)) AS split, method FROM x), y AS (SELECT DISTINCT id, length(coalesce(prerequisites, '')) > 0 AS ok FROM courses_small) SELECT split, method, count(*) AS n, round(avg(ok::INT), 6) AS precision FROM m JOIN y ON m.item = y.id GROUP BY ALL")
def lab_by_membership(spark: SparkSession, d: str) -> DataFrame:
    """A share over labelled items by split and method of their membership table."""
    m = table(spark, d, "course_membership").select("item", "split", F.coalesce(F.nullif(F.trim("method"), F.lit("")), F.lit("unknown")).alias("method")).distinct()
    y = table(spark, d, "courses_small").select(F.col("id").alias("item"), (F.length(F.coalesce("prerequisites", F.lit(""))) > 0).alias("ok")).distinct()
    return m.join(y, "item").groupBy(F.lower(F.trim("split")).alias("split"), "method").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("precision"))


# ---- trends and emerging topics -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {CTE}, u AS (SELECT ay, program, unnest(units).text AS text FROM e WHERE ay >= '2021-22'), k AS (SELECT ay, text, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_]+', '', 'g')) AS nt FROM u WHERE regexp_matches(regexp_replace(coalesce(program, ''), '(?i)\\b(?:except|excluding)\\b.*$', ''), '(?i)comput|information technology|artificial|data scien|cyber|\\bIT\\b|\\bAI\\b|\\bDS\\b|CSBS|CSE|\\bCE\\b') AND len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda w: w <> '')) >= 8)
SELECT ay, count(DISTINCT nt) AS n_units FROM k GROUP BY 1""")
def trd_units(spark: SparkSession, d: str) -> DataFrame:
    """Distinct units of computing programmes in each year: the input of topic trends."""
    e = enriched(spark, d).filter("ay >= '2021-22'").filter(C.computing(F.col("program")))
    u = e.select("ay", F.explode("units.text").alias("text")).filter(F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")) >= 8)
    return u.groupBy("ay").agg(F.count_distinct(F.lower(F.regexp_replace("text", "[^A-Za-z0-9_]+", ""))).alias("n_units"))


@query("WITH w AS (SELECT event_type, user_id % 40 AS topic, date_trunc('week', ts) AS wk FROM events), n AS (SELECT topic, wk, count(*) / sum(count(*)) OVER (PARTITION BY wk) AS share, dense_rank() OVER (ORDER BY wk) AS r, dense_rank() OVER (ORDER BY wk DESC) AS rr FROM w GROUP BY topic, wk), c AS (SELECT topic, round(coalesce(sum(share) FILTER (WHERE rr <= 2), 0) / 2 - coalesce(sum(share) FILTER (WHERE r <= 2), 0) / 2, 9) AS change FROM n GROUP BY 1) SELECT topic, round(change, 6) AS change, CASE WHEN g <= 8 THEN 'growing' ELSE 'shrinking' END AS kind FROM (SELECT *, row_number() OVER (ORDER BY change DESC, topic) AS g, row_number() OVER (ORDER BY change, topic) AS s FROM c) WHERE g <= 8 OR s <= 8")
def trd_growing(spark: SparkSession, d: str) -> DataFrame:
    """The eight topics (user groups) whose share grew most from the first to the last two weeks, and the eight that shrank most."""
    n = table(spark, d, "events").groupBy((F.col("user_id") % 40).alias("topic"), F.date_trunc("week", "ts").alias("wk")).agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("wk")))
    one = Window.partitionBy(F.lit(0))
    weeks = n.select("wk").distinct()  # a row for each week
    weeks = weeks.withColumn("r", F.row_number().over(one.orderBy("wk"))).withColumn("rr", F.row_number().over(one.orderBy(F.desc("wk"))))
    x = n.join(F.broadcast(weeks), "wk")
    part = lambda c: F.coalesce(F.sum(F.when(F.col(c) <= 2, F.col("share"))), F.lit(0.0)) / 2
    c = x.groupBy("topic").agg(F.round(part("rr") - part("r"), 9).alias("change"))  # a row for each topic
    c = c.withColumn("g", F.row_number().over(one.orderBy(F.desc("change"), "topic"))).withColumn("s", F.row_number().over(one.orderBy("change", "topic")))
    return c.filter("g <= 8 or s <= 8").select("topic", F.round("change", 6).alias("change"), F.when(F.col("g") <= 8, "growing").otherwise("shrinking").alias("kind"))


_EMG = f"""em AS (SELECT DISTINCT topic, description, programmes FROM emerging_topics WHERE verified), tq AS (SELECT topic, unnest(programmes) AS programme, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', topic, description)), '[a-z0-9]+'), lambda w: length(w) >= 3)) AS q FROM em),
uw AS (SELECT DISTINCT programme, id, i, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) >= 3)) AS t FROM (SELECT programme, id, generate_subscripts(units, 1) AS i, unnest(units).text AS text FROM vw)),
qt AS (SELECT topic, programme, len(q) AS n, unnest(q) AS t FROM tq), sc AS (SELECT topic, qt.programme, id, i, count(*) / any_value(n) AS s FROM qt JOIN uw ON uw.programme = qt.programme AND uw.t = qt.t GROUP BY ALL), eb AS (SELECT topic, programme, max(s) AS best FROM sc GROUP BY ALL)"""


def emerging(spark: SparkSession, d: str) -> DataFrame:
    from syllaweave.operators.retrieval import topic_coverage

    view = K.programme_view(enriched(spark, d).select("programmes", "common", "family", "ay", "id", "units"))
    return topic_coverage(table(spark, d, "emerging_topics").filter("verified").select("topic", "description", "programmes").distinct(), view.select("programme", "id", F.posexplode("units.text").alias("i", "text")), 0.3, 5)


@query(f"WITH {CTE}, {_EMG} SELECT topic, tq.programme, round(coalesce(best, 0), 6) AS best, coalesce(best, 0) >= 0.3 AS covered FROM (SELECT DISTINCT topic, programme FROM tq) tq LEFT JOIN eb USING (topic, programme)")
def emg_text_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each verified topic's words that the best unit of each of its programmes holds; a gap below 0.3."""
    return emerging(spark, d).select("topic", "programme", F.round("best", 6).alias("best"), "covered")


@query(f"WITH {CTE}, {_EMG} SELECT tq.programme, count(*) AS checked, count_if(coalesce(best, 0) < 0.3)::BIGINT AS gaps FROM (SELECT DISTINCT topic, programme FROM tq) tq LEFT JOIN eb USING (topic, programme) GROUP BY 1")
def emg_report(spark: SparkSession, d: str) -> DataFrame:
    """Topics checked and gaps of each programme."""
    return emerging(spark, d).groupBy("programme").agg(F.count("*").alias("checked"), F.count_if(~F.col("covered")).alias("gaps"))
