"""Queries of fitted models, reports over other answers, and the rules of the older engine, with DuckDB's SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from syllaweave.functions import course as C, rules
from syllaweave.functions.text import jaccard, reduced, words_of
from syllaweave.operators import assemble as A, catalog as K, metrics as M, models, prerequisites as P, retrieval as T
from syllaweave.operators.graph import components
from syllaweave.operators.text_pairs import text_pairs
from syllaweave.plans import answer_queries as ANS, lexical_queries as LEX, schedule_queries as S, web_queries as WEB
from syllaweave.plans.catalog_queries import CTE, enriched, versions
from syllaweave.session import small, written
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


# ---- prerequisites ------------------------------------------------------------------------------------------------------------------------

_GEN = ", ".join(f"'{w}'" for w in rules.GENERIC_NAME_WORDS.split())
_CWD = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z]+'), lambda w: w NOT IN ({_GEN})))"
_IN = "(list_contains({1}, {0}) OR list_contains({1}, {0} || 's') OR (ends_with({0}, 's') AND list_contains({1}, left({0}, length({0}) - 1))))"
_UMB = " OR ".join(f"(t = '{s}' AND ({' OR '.join(_IN.format(chr(39) + w + chr(39), '{0}') for w in ws.split())}))" for s, ws in rules.UMBRELLA.items())
_MET = "(len(pw) > 0 AND len(list_filter(pw, lambda t: NOT (" + _IN.format("t", "{0}") + " OR " + _UMB + "))) = 0)"


@query(f"""WITH {CTE}, x AS (SELECT id, course_name, regexp_replace(coalesce(prerequisites, ''), '\\(([^)]*\\d[^)]*)\\)', ' ', 'g') AS t FROM c), p AS (SELECT DISTINCT id, course_name, unnest({S._SPLIT1}) AS phrase FROM x),
k AS (SELECT lead_ AS n2, id FROM (SELECT id, lead(course_name) OVER (ORDER BY id) AS lead_ FROM c)), w AS (SELECT p.id, phrase, {_CWD.format('phrase')} AS pw, {_CWD.format('course_name')} AS wa, {_CWD.format('n2')} AS wb FROM p JOIN k USING (id))
SELECT id, phrase, {_MET.format('wa')} OR {_MET.format('wb')} AS single, {_MET.format('list_concat(wa, wb)')} AS pooled FROM w""")
def pre_alias(spark: SparkSession, d: str) -> DataFrame:
    """Phrases met by the name of their own course or of the next one (by id), by one name alone and by the words of both together."""
    v = versions(spark, d).select("id", "course_name", "prerequisites")
    from syllaweave.sources.files import numbered

    n = numbered(v, ["id"], "n")
    v = n.join(n.select((F.col("n") - 1).alias("n"), F.col("course_name").alias("next")), "n", "left")
    p = v.select("id", F.explode(C.split_prerequisites(F.col("prerequisites"))).alias("phrase"), F.array("course_name", "next").alias("names"))
    return p.select("id", "phrase", P.alias_met_any(F.col("phrase"), F.col("names")).alias("single"), P.alias_met_any(F.col("phrase"), F.col("names"), single=False).alias("pooled"))


_PCH = "list_filter(list_transform(regexp_split_to_array(coalesce(prerequisites, ''), '" + A.PHRASE_BREAK + "'), lambda p: regexp_replace(regexp_replace(p, '^[^A-Za-z]+|[\\s\\xA0]+$', '', 'g'), '" + f"(?i)^(?:{A.DETERMINERS[5:]}|{A.LEAD_VERB[5:]})+" + "', '')), lambda p: length(p) > 2 AND len(list_filter(regexp_extract_all(lower(p), '[a-z][a-z+\\-]*'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in A.GENERIC_SKILL_WORDS.split()) + "))) > 0)"


@query(f"WITH {CTE} SELECT id, array_to_string({_PCH}, '|') AS chunks FROM c")
def pre_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Prerequisite fields cut into noun-like phrases by rule."""
    return versions(spark, d).select("id", F.array_join(A.skill_phrases(F.col("prerequisites")), "|").alias("chunks"))


_ROM = "CASE w " + " ".join(f"WHEN '{r.lower()}' THEN '{i}'" for i, r in enumerate(rules.ROMAN, 1)) + " ELSE w END"


@query(f"WITH {CTE}, x AS (SELECT id, regexp_replace(coalesce(prerequisites, ''), '\\(([^)]*\\d[^)]*)\\)', ' ', 'g') AS t FROM c), p AS (SELECT DISTINCT id, unnest({S._SPLIT1}) AS phrase FROM x) SELECT id, phrase, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(phrase), '[a-z0-9]+'), lambda w: {_ROM}))), ' ') AS tokens FROM p")
def pre_phrase_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Phrases as sorted sets of words with Roman numerals as digits."""
    p = versions(spark, d).select("id", F.explode(C.split_prerequisites(F.col("prerequisites"))).alias("phrase"))
    return p.select("id", "phrase", F.array_join(F.array_sort(C.phrase_tokens(F.col("phrase"))), " ").alias("tokens"))


@query(f"""WITH ps AS (SELECT DISTINCT trim(course_name) AS phrase FROM courses_small WHERE trim(course_name) <> ''), {WEB._COS}, z AS (SELECT ps.phrase, coalesce(score, 0) AS s, regexp_replace(replace(lower(ps.phrase), '&', 'and'), '[^a-z0-9]+', '', 'g') = regexp_replace(replace(lower(r.name), '&', 'and'), '[^a-z0-9]+', '', 'g') AS exact FROM ps LEFT JOIN r USING (phrase))
SELECT CASE WHEN s >= 0.9 THEN '0.9' WHEN s >= 0.75 THEN '0.75' WHEN s >= 0.6 THEN '0.6' ELSE '0' END AS band, count(*) AS n, round(avg(coalesce(exact, false)::INT), 6) AS exact_share FROM z GROUP BY 1""")
def pre_similarity_bands(spark: SparkSession, d: str) -> DataFrame:
    """How many typed names resolve in each band of similarity, and the share that is the entry's name itself."""
    r = WEB.ret_catalog_resolve(spark, d).withColumn("s", F.coalesce("score", F.lit(0.0)))
    band = F.when(F.col("s") >= 0.9, "0.9").when(F.col("s") >= 0.75, "0.75").when(F.col("s") >= 0.6, "0.6").otherwise("0")
    exact = F.coalesce(reduced(F.col("phrase")) == reduced(F.col("name")), F.lit(False))
    return r.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(exact.cast("double")), 6).alias("exact_share"))


@query(f"""WITH {ANS.PAIRS}, x AS (SELECT prs.id_a, prs.id_b, regexp_replace(coalesce(prerequisites, ''), '\\(([^)]*\\d[^)]*)\\)', ' ', 'g') AS t FROM prs JOIN c ON c.id = id_a), p AS (SELECT DISTINCT id_a, id_b, unnest({S._SPLIT1}) AS phrase FROM x), w AS (SELECT *, {_CWD.format('phrase')} AS pw FROM p),
o AS (SELECT id, list_distinct(regexp_extract_all(lower({ANS._TEXT}), '[a-z]+')) AS ws FROM c), k AS (SELECT DISTINCT regexp_replace(replace(lower(course_name), '&', 'and'), '[^a-z0-9]+', '', 'g') AS k FROM c)
SELECT id_a, id_b, phrase, round(len(list_intersect(pw, ws)) / greatest(1, len(pw)), 6) AS cover FROM w JOIN o ON o.id = id_b WHERE regexp_replace(replace(lower(phrase), '&', 'and'), '[^a-z0-9]+', '', 'g') NOT IN (SELECT k FROM k WHERE k IS NOT NULL) AND len(list_intersect(pw, ws)) / greatest(1, len(pw)) < 0.5""")
def pre_missing_in_other(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of a version that name no course and that the next version's own text covers by less than half of their words."""
    v = versions(spark, d)
    pairs = ANS.version_pairs(enriched(spark, d)).select("id_a", "id_b")
    p = v.select(F.col("id").alias("id_a"), F.explode(C.split_prerequisites(F.col("prerequisites"))).alias("phrase")).distinct()
    names = v.select(reduced(F.col("course_name")).alias("k")).filter("k is not null").distinct()
    p = p.withColumn("k", reduced(F.col("phrase"))).join(names, "k", "left_anti").join(pairs, "id_a")
    o = v.select(F.col("id").alias("id_b"), F.array_distinct(F.regexp_extract_all(F.lower(C.course_text()), F.lit("[a-z]+"), F.lit(0))).alias("ws"))
    pw = P.content_words(F.col("phrase"))
    x = p.join(o, "id_b").withColumn("cover", F.size(F.array_intersect(pw, F.col("ws"))) / F.greatest(F.lit(1), F.size(pw)))
    return x.filter("cover < 0.5").select("id_a", "id_b", "phrase", F.round("cover", 6).alias("cover"))


# ---- overlap and redundancy ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {ANS.PAIRS}, {ANS.FEATURES} SELECT id_a, id_b, CASE WHEN confidence >= 0.8 THEN 'redundant' WHEN overlap >= 0.5 THEN 'overlapping' ELSE 'different' END AS verdict FROM cf WHERE abs(confidence - 0.8) > 1e-9")
def ov_report(spark: SparkSession, d: str) -> DataFrame:
    """A verdict on each pair of versions: by calibrated confidence, else by the share of matched units."""
    x = ANS._features(spark, d, ANS.version_pairs(enriched(spark, d))).filter(F.abs(F.col("confidence") - 0.8) > 1e-9)
    return x.select("id_a", "id_b", F.when(F.col("confidence") >= 0.8, "redundant").when(F.col("overlap") >= 0.5, "overlapping").otherwise("different").alias("verdict"))


_REPW = f"""rp AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY family ORDER BY ay DESC, n_source_files DESC NULLS LAST, id DESC) = 1), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({LEX._terms(ANS._TEXT)}) AS term FROM rp) GROUP BY ALL), nd AS (SELECT count(*) AS n FROM rp),
df AS (SELECT term, count(*) AS df FROM tf, nd GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.8::DOUBLE * n), raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + n)::DOUBLE / (1.0 + df)::DOUBLE) + 1) AS w0 FROM tf JOIN df USING (term), nd), w AS (SELECT id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY id)) AS w FROM raw),
cp AS (SELECT a.id AS id_a, b.id AS id_b, round(sum(a.w * b.w), 9) AS sim FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY ALL)"""


def _course_texts(spark: SparkSession, d: str) -> DataFrame:
    """``(id, programmes, text)`` of the representatives, a stage table; only their texts are read on, whole rows are never shuffled."""
    r = written(K.representatives(enriched(spark, d).select("family", "id", "ay", "n_source_files", "programmes")).select("id", "programmes"), "courses")
    own = table(spark, d, "courses_small").join(small(r.select("id")), "id", "left_semi").select("id", C.course_text().alias("text"))
    return written(own.join(small(r), "id").dropDuplicates(["id"]), "texts")


def _course_pairs(r: DataFrame, least: float) -> DataFrame:
    p = text_pairs(r.select("id", F.lit(0).alias("g"), "text"), "id", "g", F.col("text"), least, block=3_000)
    return p.select(F.col("doc_a").alias("id_a"), F.col("doc_b").alias("id_b"), F.round("sim", 9).alias("sim"))


@query(f"""WITH RECURSIVE {CTE}, {_REPW}, ed AS (SELECT id_a AS x, id_b AS y FROM cp WHERE sim >= 0.5 UNION ALL SELECT id_b, id_a FROM cp WHERE sim >= 0.5), r AS (SELECT x, x AS y FROM ed UNION SELECT r.x, ed.y FROM r JOIN ed ON r.y = ed.x), m AS (SELECT x AS id, min(y) AS cluster FROM r GROUP BY 1) SELECT cluster, count(*) AS n, max(id) AS last_id FROM m GROUP BY 1""")
def ret_near_courses(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of courses linked by a TF-IDF cosine of 0.5 or more."""
    p = _course_pairs(_course_texts(spark, d), 0.5)
    roots = components(p, "id_a", "id_b")
    return roots.groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("n"), F.max("node").alias("last_id"))


@query(f"WITH {CTE}, {_REPW}, pg AS (SELECT id, unnest(programmes) AS programme FROM rp), x AS (SELECT pa.programme, cp.id_a, cp.id_b, cp.sim FROM cp JOIN pg pa ON pa.id = id_a JOIN pg pb ON pb.id = id_b AND pb.programme = pa.programme WHERE cp.sim >= 0.3) SELECT programme, id_a, id_b, round(sim, 6) AS sim FROM x ORDER BY x.sim DESC, programme, id_a, id_b LIMIT 20")
def red_course_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The twenty course pairs of one programme with the largest TF-IDF cosine (a top-k report)."""
    r = _course_texts(spark, d)
    pg = r.select("id", F.explode("programmes").alias("programme"))
    a, b = pg.withColumnRenamed("id", "id_a"), pg.withColumnRenamed("id", "id_b")
    for least in (0.9, 0.6, 0.3):  # twenty that surely beat every pair under a bound are the twenty of all pairs
        x = _course_pairs(r, least).join(a, "id_a").join(b, ["id_b", "programme"])
        if least == 0.3 or x.filter(F.col("sim") > least + 1e-8).limit(20).count() == 20:
            break
    return x.orderBy(F.desc("sim"), "programme", "id_a", "id_b").limit(20).select("programme", "id_a", "id_b", F.round("sim", 6).alias("sim"))


@query()
def ov_confidence_fit(spark: SparkSession, d: str) -> DataFrame:
    """The confidence model fitted on version pairs: any overlap is a Jaccard of 0.3 or more of their words; five folds by family."""
    e = enriched(spark, d)
    p = ANS.version_pairs(e)
    w = versions(spark, d).select("id", F.array_distinct(words_of(C.course_text())).alias("w"))
    y = p.join(w.toDF("id_a", "wa"), "id_a").join(w.toDF("id_b", "wb"), "id_b").select("family", "id_a", "id_b", (jaccard(F.col("wa"), F.col("wb")) >= 0.3).cast("double").alias("y"))
    x = written(ANS._features(spark, d, p).join(y, ["id_a", "id_b"]), "features")
    return models.fit_logistic(x, "y", ["tfidf", "soft", "max_unit"], "family")


_WSET = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_HASH = "('0x' || substr(md5('42:' || (i - 1) || ':' || w), {0}, 6))::BIGINT / 16777216.0::DOUBLE"


@query(f"""WITH {ANS.PAIRS}, tx AS (SELECT id, {ANS._TEXT} AS text FROM c), q0 AS (SELECT id_a, id_b, 1 AS y FROM prs UNION ALL SELECT id_a, lead(id_b) OVER (ORDER BY id_a) AS id_b, 0 FROM prs), q AS (SELECT id_a, id_b, max(y) AS y FROM q0 WHERE id_b IS NOT NULL AND id_a <> id_b GROUP BY ALL),
wd AS (SELECT id, text, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS ws FROM tx), t AS (SELECT id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM wd), h AS (SELECT *, {_HASH.format(1)} AS a, (floor({_HASH.format(7)} * (length(w) - 3)) + 2)::INT AS k FROM t),
ty AS (SELECT id, string_agg(CASE WHEN length(w) > 3 AND a < 0.05 THEN substr(w, 1, k - 1) || substr(w, k + 1, 1) || substr(w, k, 1) || substr(w, k + 2) ELSE w END, ' ' ORDER BY i) AS p, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE a >= 0.15), min(w) FILTER (WHERE i = 1)) AS dr FROM h GROUP BY 1),
tr AS (SELECT id, 'none' AS kind, text AS p FROM wd UNION ALL SELECT id, 'truncate', array_to_string(ws[1:greatest(1, floor(len(ws) * 0.5)::INT)], ' ') FROM wd UNION ALL SELECT wd.id, 'typos', coalesce(p, '') FROM wd LEFT JOIN ty USING (id) UNION ALL SELECT wd.id, 'drop', coalesce(dr, '') FROM wd LEFT JOIN ty USING (id)),
sa AS (SELECT id, {_WSET.format('text')} AS wa FROM tx), sb AS (SELECT id, kind, {_WSET.format('p')} AS wb FROM tr), sc AS (SELECT kind, y, round(len(list_intersect(wa, wb)) / greatest(1, len(list_distinct(list_concat(wa, wb)))), 9) AS s FROM q JOIN sa ON sa.id = id_a JOIN sb ON sb.id = id_b),
rk AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY s) + (count(*) OVER (PARTITION BY kind, s) - 1) / 2 AS r FROM sc) SELECT kind, round((sum(r) FILTER (WHERE y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2) / (count_if(y = 1) * count_if(y = 0)), 6) AS auc FROM rk GROUP BY 1""")
def rob_rescored(spark: SparkSession, d: str) -> DataFrame:
    """How well word overlap tells versions of one course from others when one side is changed: AUC for each kind of change."""
    v = versions(spark, d).select("id", C.course_text().alias("text"))
    p = ANS.version_pairs(enriched(spark, d)).select("id_a", "id_b")
    from syllaweave.sources.files import numbered

    n = numbered(p, ["id_a"], "n")
    q = p.withColumn("y", F.lit(True)).unionByName(n.select("n", "id_a").join(n.select((F.col("n") - 1).alias("n"), "id_b"), "n").select("id_a", "id_b", F.lit(False).alias("y")))
    q = q.filter("id_a <> id_b").groupBy("id_a", "id_b").agg(F.max("y").alias("y"))
    w = lambda c: F.array_distinct(words_of(c))
    kinds = {"none": F.col("text"), **{k: A.perturb(F.col("text"), k, r, 42) for k, r in (("typos", 0.05), ("drop", 0.15), ("truncate", 0.5))}}
    b = v.select(F.col("id").alias("id_b"), F.explode(F.create_map(*[x for k, c in kinds.items() for x in (F.lit(k), w(c))])).alias("kind", "wb"))
    x = q.join(v.select(F.col("id").alias("id_a"), w(F.col("text")).alias("wa")), "id_a").join(b, "id_b").select("kind", "y", F.round(jaccard(F.col("wa"), F.col("wb")), 9).alias("s"))
    return M.auc(x, "y", "s", ["kind"]).withColumn("auc", F.round("auc", 6))


# ---- search, summaries, reports -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {LEX._BM25}, {LEX._TFIDF_Q}, u AS (SELECT item_no, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM br UNION ALL SELECT item_no, doc_id, 1.0::DOUBLE / (60 + rank) FROM tr), f AS (SELECT item_no, doc_id, round(sum(s), 9) AS score FROM u GROUP BY ALL), h AS (SELECT item_no, doc_id, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT 'keyword' AS mode, item_no, doc_id, rank FROM br WHERE rank <= 3 UNION ALL SELECT 'vector', item_no, doc_id, rank FROM tr WHERE rank <= 3 UNION ALL SELECT 'hybrid', item_no, doc_id, rank FROM h WHERE rank <= 3""")
def ret_modes(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents of every search mode for each test passage."""
    tf, q, only = LEX._counts(spark, d)
    n = table(spark, d, "documents").count()
    out = None
    for mode in ("keyword", "vector", "hybrid"):
        r = T.search(mode, lambda: LEX._bm25(tf, q, only), lambda: LEX._tfidf(tf, q, only, n), "item_no", "doc_id").filter("rank <= 3").select(F.lit(mode).alias("mode"), "item_no", "doc_id", F.col("rank").cast("bigint").alias("rank"))
        out = r if out is None else out.unionByName(r)
    return out


_RWS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda w: length(w) >= 3))"


@query(f"""WITH {LEX._BM25}, x AS (SELECT br.item_no, br.doc_id, br.rank, {_RWS.format('i.text')} AS wi, {_RWS.format('d.text')} AS wd FROM br JOIN heldout_items i USING (item_no) JOIN documents d USING (doc_id)), s AS (SELECT item_no, doc_id, rank, round(len(list_intersect(wi, wd)) / greatest(1, len(wi)), 9) AS s FROM x)
SELECT item_no, doc_id, row_number() OVER (PARTITION BY item_no ORDER BY s DESC, rank, doc_id) AS rank, round(s, 6) AS sim FROM s""")
def ret_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents by keywords in the order of a second score: the share of the passage's words."""
    items = LEX._items(spark, d).select("item_no", T.long_words(F.col("text")).alias("wi"))
    docs = table(spark, d, "documents").select("doc_id", T.long_words(F.col("text")).alias("wd"))

    def score(h: DataFrame) -> DataFrame:
        x = h.join(items, "item_no").join(docs, "doc_id")
        return x.withColumn("sim", F.round(F.size(F.array_intersect("wi", "wd")) / F.greatest(F.lit(1), F.size("wi")), 9))

    r = T.rerank(LEX._bm25(*LEX._counts(spark, d)), "item_no", "doc_id", score)
    return r.select("item_no", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("sim", 6).alias("sim"))


@query(f"""WITH {LEX._BM25}, ws AS (SELECT doc_id, {LEX._SPLIT} AS ws FROM documents), ps AS (SELECT doc_id, i // 75 AS part, array_to_string(ws[i + 1:i + 100], ' ') AS passage FROM (SELECT doc_id, ws, unnest(range(0, (ceil(greatest(len(ws) - 100, 0) / 75.0) * 75 + 1)::BIGINT, 75)) AS i FROM ws WHERE len(ws) > 0)),
x AS (SELECT br.item_no, br.doc_id, part, passage, len(list_intersect({_RWS.format('i.text')}, {_RWS.format('passage')})) AS n FROM br JOIN heldout_items i USING (item_no) JOIN ps USING (doc_id) WHERE br.rank <= 3)
SELECT item_no, doc_id, part::BIGINT AS part, n, array_to_string(regexp_split_to_array(passage, ' ')[1:30], ' ') AS shown FROM x QUALIFY row_number() OVER (PARTITION BY item_no, doc_id ORDER BY n DESC, part) = 1""")
def ret_best_passage(spark: SparkSession, d: str) -> DataFrame:
    """The passage of each hit that holds most of the query's words, its first thirty words."""
    hits = LEX._bm25(*LEX._counts(spark, d)).filter("rank <= 3").select("item_no", "doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(C.passages(F.col("text"))).alias("part", "passage"))
    x = hits.join(LEX._items(spark, d).select("item_no", T.long_words(F.col("text")).alias("wi")), "item_no").join(docs, "doc_id")
    x = x.withColumn("n", F.size(F.array_intersect("wi", T.long_words(F.col("passage")))))
    w = Window.partitionBy("item_no", "doc_id").orderBy(F.desc("n"), "part")
    return x.withColumn("r", F.row_number().over(w)).filter("r = 1").select("item_no", "doc_id", F.col("part").cast("bigint").alias("part"), F.col("n").cast("bigint").alias("n"), C.first_words(F.col("passage"), 30).alias("shown"))


@query(f"WITH {CTE}, x AS (SELECT id, coalesce(array_to_string((list_filter(list_transform(units, lambda u: u.title), lambda t: coalesce(t, '') <> ''))[1:3], '; '), '') AS s, objectives, course_name FROM c), u AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda w: length(w) >= 4)) AS ws, regexp_extract_all(lower(coalesce(objectives, '')), '[a-z0-9]+') AS src FROM x), gd AS (SELECT *, len(list_filter(ws, lambda w: NOT list_contains(src, w))) / greatest(len(ws), 1) AS rate FROM u) SELECT id, rate <= 0.2 AND s <> '' AS accepted, CASE WHEN rate <= 0.2 AND s <> '' THEN s ELSE 'The course ' || coalesce(course_name, '') || ' has no accepted summary.' END AS summary FROM gd")
def sum_guarded(spark: SparkSession, d: str) -> DataFrame:
    """A summary is taken only if four fifths of its words stand in its source and its percentages do too, else a template."""
    x = versions(spark, d).select("id", F.coalesce(A.lead_summary(), F.lit("")).alias("s"), "objectives", "course_name")
    template = F.concat(F.lit("The course "), F.coalesce("course_name", F.lit("")), F.lit(" has no accepted summary."))
    ok = A.supported(F.col("s"), F.col("objectives"), 0.2)
    return x.select("id", ok.alias("accepted"), F.when(ok, F.col("s")).otherwise(template).alias("summary"))


@query(f"""WITH {CTE}, ss AS (SELECT id, generate_subscripts(s, 1) AS i, unnest(s) AS sentence FROM (SELECT id, list_filter(list_transform(units, lambda u: array_to_string((list_filter(regexp_split_to_array(trim(coalesce(u.text, '')), '\\s+'), lambda w: w <> ''))[1:30], ' ')), lambda t: t <> '') AS s FROM c)),
tf AS (SELECT id, i, term, count(*) AS tf FROM (SELECT id, i, unnest({LEX._terms('sentence')}) AS term FROM ss) GROUP BY ALL), h AS (SELECT id, i, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h, tf FROM tf), v0 AS (SELECT id, i, h % 256 AS dim, sum(CASE WHEN (h // 256) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(tf))) AS v FROM h GROUP BY ALL HAVING abs(v) > 1e-9), v AS (SELECT id, i, dim, v / sqrt(sum(v * v) OVER (PARTITION BY id, i)) AS v FROM v0),
n AS (SELECT id, count(DISTINCT i) AS n FROM v GROUP BY 1), m AS (SELECT id, dim, sum(v) / any_value(n) AS m FROM v JOIN n USING (id) GROUP BY ALL), d AS (SELECT id, i, round(sum(v * m), 9) AS s FROM v JOIN m USING (id, dim) GROUP BY ALL), t AS (SELECT id, i FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, i) <= 2)
SELECT id, string_agg(sentence, ' ' ORDER BY i) AS summary FROM t JOIN ss USING (id, i) GROUP BY 1""")
def sum_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The two unit texts (their first thirty words) of each course that are closest to its mean vector, in their order."""
    s = F.filter(F.transform("units", lambda u: C.first_words(u["text"], 30)), lambda t: t != "")
    x = versions(spark, d).select("id", F.posexplode(s).alias("i", "sentence"))
    return A.central(x, "id", "i", "sentence", 2)


@query(f"WITH {CTE}, w AS (SELECT id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({ANS._TEXT}), '[a-z]{{2,}}'), lambda w: w NOT IN ({LEX._STOP})), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(?:ments?|ed|ing|es|s)$', '') ELSE w END))) AS s FROM c) SELECT id, len(s) AS n, md5(array_to_string(s, ' ')) AS hash FROM w")
def txt_stems(spark: SparkSession, d: str) -> DataFrame:
    """Distinct light stems of the content words of each course."""
    from syllaweave.operators.webpages import content_words

    s = F.array_sort(F.array_distinct(F.transform(content_words(C.course_text()), lambda w: C.light_stem(w))))
    return versions(spark, d).select("id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, " ")).alias("hash"))


@query(f"WITH {S.OUT} SELECT DISTINCT ON (text) text, k[1]::INT AS level, id FROM b2 WHERE len(k) = 1 AND text IS NOT NULL ORDER BY text, id, k[1]")
def blm_training_set(spark: SparkSession, d: str) -> DataFrame:
    """Distinct statements with exactly one level; of several the first version's counts."""
    o = S._outcomes(spark, d).filter("size(k) = 1 and text is not null").select("text", F.get("k", F.lit(0)).alias("level"), "id")
    return o.groupBy("text").agg(F.min(F.struct("id", "level")).alias("f")).select("text", "f.level", "f.id")


@query(f"WITH {S.OUT}, {S._TAGGED.replace('SELECT family,', 'SELECT text, family,')}, x AS (SELECT DISTINCT text, y, p FROM tg) SELECT CASE WHEN y = p THEN 'right' ELSE 'wrong' END AS label, y, text FROM x QUALIFY row_number() OVER (PARTITION BY y = p, y ORDER BY length(text) DESC, text, p) = 1")
def txt_examples(spark: SparkSession, d: str) -> DataFrame:
    """The longest rightly and wrongly levelled statement of each level (a top-1 report)."""
    x = S._outcomes(spark, d).filter("size(k) = 1").select("text", F.get("k", F.lit(0)).alias("y"), F.coalesce("level", F.lit(3)).alias("p")).distinct()
    x = x.withColumn("label", F.when(F.col("y") == F.col("p"), "right").otherwise("wrong"))
    w = Window.partitionBy("label", "y").orderBy(F.desc(F.length("text")), "text", "p")
    return x.withColumn("n", F.row_number().over(w)).filter("n = 1").select("label", "y", "text")


@query(f"WITH {ANS._GAPS}, j AS (SELECT count(DISTINCT doc_id) AS jobs, count(*) AS phrases FROM jp), r AS (SELECT count(*) AS requirements FROM jr) SELECT jobs, requirements, phrases, count(*) AS themes, count_if(kind = 'covered')::BIGINT AS covered, count_if(kind = 'tool')::BIGINT AS tools, count_if(kind = 'gap')::BIGINT AS gaps FROM gk, j, r GROUP BY ALL")
def mod_summary(spark: SparkSession, d: str) -> DataFrame:
    """The modernise step in numbers."""
    jobs = table(spark, d, "documents").filter("doc_kind = 'job_description'")
    p = jobs.select("doc_id", F.explode(C.requirements(F.col("text"))).alias("r"))
    q = p.select("doc_id", F.explode(A.skill_phrases(F.col("r"))).alias("p"))
    a = q.agg(F.count_distinct("doc_id").alias("jobs"), F.count("*").alias("phrases")).crossJoin(p.agg(F.count("*").alias("requirements")))
    k = F.col("kind")
    return a.crossJoin(ANS.ans_skill_gaps(spark, d).agg(F.count("*").alias("themes"), F.count_if(k == "covered").alias("covered"), F.count_if(k == "tool").alias("tools"), F.count_if(k == "gap").alias("gaps")))


@query(f"""WITH {S.OUT}, {S._TAGGED}, m AS (SELECT 'lexicon' AS method, avg((y = p)::INT) AS accuracy, avg((abs(y - p) <= 1)::INT) AS within_one FROM tg UNION ALL SELECT 'majority', avg((y = k)::INT), avg((abs(y - k) <= 1)::INT) FROM tg, (SELECT y AS k FROM tg GROUP BY 1 ORDER BY count(*) DESC, y LIMIT 1))
SELECT method, printf('%.3f', round(accuracy, 9)) AS accuracy, printf('%.3f', round(within_one, 9)) AS within_one FROM m""")
def evl_summary_table(spark: SparkSession, d: str) -> DataFrame:
    """Baseline and lexicon side by side, as a report prints them."""
    t = S._tagged(spark, d)
    top = t.groupBy(F.col("y").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(1).select("k")
    rows = t.select(F.lit("lexicon").alias("method"), "y", "p").unionByName(t.crossJoin(F.broadcast(top)).select(F.lit("majority").alias("method"), "y", F.col("k").alias("p")))
    share = lambda c: F.format_string("%.3f", F.round(F.avg(c.cast("double")), 9))
    return rows.groupBy("method").agg(share(F.col("y") == F.col("p")).alias("accuracy"), share(F.abs(F.col("y") - F.col("p")) <= 1).alias("within_one"))


@query()
def txt_topic_classifier(spark: SparkSession, d: str) -> DataFrame:
    """One logistic model for each frequent unit title as a label of its text: micro and macro F1 on a fifth of the versions, by the best of three penalties."""
    u = versions(spark, d).select("id", F.explode("units").alias("u")).select("id", F.lower(F.trim("u.title")).alias("t"), "u.text").filter("t <> ''")
    top = u.groupBy("t").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "t").limit(4).select("t")  # the labels that are modelled
    return models.one_against_rest(u.groupBy("id", "text").agg(F.collect_set("t").alias("labels")), "text", "labels", [r[0] for r in top.collect()], "id")


# the second rule set of prerequisite flags, whose query stands with the schedule
_CS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]+'), lambda w: w NOT IN (" + _GEN + ")), lambda t: regexp_replace(t, 's$', '')))"


def _close(out: str, phrases: str, texts: str, least: float) -> str:
    """CTEs that end in ``out(phrase, text, sim)``: cosine of content words of ``phrases`` and ``texts``."""
    return f"""{out}_p AS (SELECT phrase, len(w) AS n, unnest(w) AS k FROM (SELECT phrase, {_CS.format('phrase')} AS w FROM (SELECT DISTINCT phrase FROM {phrases}))), {out}_t AS (SELECT text, len(w) AS n, unnest(w) AS k FROM (SELECT text, {_CS.format('text')} AS w FROM (SELECT DISTINCT text FROM {texts}))),
{out} AS (SELECT phrase, text, count(*) / sqrt(any_value(p.n) * any_value(t.n)) AS sim FROM {out}_p p JOIN {out}_t t USING (k) GROUP BY ALL HAVING sim >= {least} - 1e-9)"""


_TOPICS = "list_filter(list_transform(regexp_split_to_array(coalesce(u.text, ''), '[,;:.()\\n]|\\s[-–]\\s'), lambda t: trim(t, ' ')), lambda t: t <> '')"
ORACLE["pre_flags_v2"] = f"""WITH RECURSIVE {S.PRE}, {S.SPLIT2}, vp AS (SELECT DISTINCT ck.programme, ck.family, ck.sem, phrase FROM ck JOIN s7 USING (id) WHERE NOT regexp_matches(phrase, '{rules.NON_SUBJECT}')),
fm AS (SELECT family, arg_min_null(course_name, id) AS name FROM e GROUP BY 1), mw AS (SELECT DISTINCT vp.programme, vp.family, vp.sem, phrase, {_CWD.format('phrase')} AS pw, {_CWD.format('fm.name')} AS nw FROM vp JOIN er ON er.programme = vp.programme AND er.first_sem < vp.sem JOIN fm ON fm.family = er.family),
mt AS (SELECT DISTINCT programme, family, sem, phrase FROM mw WHERE {_MET.format('nw')}), r0 AS (SELECT * FROM vp ANTI JOIN mt USING (programme, family, sem, phrase)),
ow AS (SELECT DISTINCT programme, family, unnest({_TOPICS}) AS text FROM (SELECT programme, family, unnest(units) AS u FROM ck)), rpv AS (SELECT family, units FROM e QUALIFY row_number() OVER (PARTITION BY family ORDER BY ay DESC, n_source_files DESC NULLS LAST, id DESC) = 1), ta AS (SELECT DISTINCT family, unnest({_TOPICS}) AS text FROM (SELECT family, unnest(units) AS u FROM rpv)),
{_close('c1', 'r0', 'ow', P.OWN)}, it AS (SELECT DISTINCT programme, family, phrase FROM c1 JOIN ow USING (text)), r1 AS (SELECT * FROM r0 ANTI JOIN it USING (programme, family, phrase)), cn2 AS (SELECT DISTINCT course_name AS text, family AS resolved_family FROM e),
{_close('c2', 'r0', 'cn2', P.RESOLVE)}, nr AS (SELECT phrase, resolved_family, sim, text FROM c2 JOIN cn2 USING (text) UNION ALL SELECT phrase, nm.resolved_family, 1.0, phrase FROM (SELECT DISTINCT phrase FROM r0) JOIN nm ON nm.k = regexp_replace(replace(lower(phrase), '&', 'and'), '[^a-z0-9]+', '', 'g')),
rs AS (SELECT r1.*, nr.resolved_family, nr.sim, nr.text, coalesce(er.first_sem < r1.sem, false) AS before FROM r1 LEFT JOIN nr USING (phrase) LEFT JOIN er ON er.programme = r1.programme AND er.family = nr.resolved_family QUALIFY row_number() OVER (PARTITION BY r1.programme, r1.family, r1.sem, phrase ORDER BY before DESC, round(sim, 9) DESC NULLS LAST, text, nr.resolved_family) = 1),
{_close('c3', 'r0', 'ta', P.TOPIC)}, kn AS (SELECT er.programme, phrase, min(first_sem) AS taught_sem FROM c3 JOIN ta USING (text) JOIN er ON er.family = ta.family GROUP BY ALL)
SELECT programme, rs.family, sem, phrase, resolved_family, CASE WHEN resolved_family IS NULL THEN 'assumed_topic_not_taught' ELSE 'not_offered_earlier' END AS type FROM rs LEFT JOIN kn USING (programme, phrase) WHERE CASE WHEN resolved_family IS NULL THEN taught_sem IS NULL OR taught_sem >= sem ELSE resolved_family <> rs.family AND NOT before END"""
