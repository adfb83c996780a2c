"""Queries of web course pages, page text, tags and free text, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from syllaweave.functions import course as C, rules
from syllaweave.functions.text import reduced, words_of
from syllaweave.operators import parse as P, retrieval as T, webpages as W
from syllaweave.operators.lexical import STOP_WORDS
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


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), 'https?://\S+|\S+@\S+', ' ', 'g'), '(?i)\(\s*(?:PDF|MP4|ZIP|TXT|XLS)[^)]*\)', ' ', 'g'), '(?i)\b(?:courtesy of|image by|used with permission)[^.]*\.?', ' ', 'g'), '\s+', ' ', 'g'))"""
_NW = r"len(list_filter(regexp_split_to_array(trim(coalesce({0}, '')), '\s+'), lambda w: w <> ''))"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS.split())
_WEB = f"""wu AS (SELECT id, [{{'h': 'Course overview', 't': objectives}}, {{'h': 'Prerequisites', 't': prerequisites}}, {{'h': 'Grading policy', 't': 'Two exams count.'}}] AS a, list_transform(coalesce(units, []), lambda u: {{'h': u.title, 't': u.text}}) AS b FROM c),
ws AS (SELECT id, unnest(list_concat(a, b)) AS s, generate_subscripts(list_concat(a, b), 1) AS i FROM wu), wk AS (SELECT id, i, lower(coalesce(s.h, '')) AS h, {_CLEAN.format('s.t')} AS t FROM ws),
wp AS (SELECT id, string_agg(t, ' ' ORDER BY i) FILTER (WHERE contains(h, 'prereq')) AS pre, string_agg(t, ' ' ORDER BY i) FILTER (WHERE NOT contains(h, 'prereq')) AS body FROM wk WHERE (regexp_matches(h, '{rules.KEEP_SECTION}') OR NOT regexp_matches(h, '{rules.DROP_SECTION}')) AND (trim(h) <> '' OR t <> '') GROUP BY 1),
wt AS (SELECT id, list_distinct(list_filter(list_transform(outcomes, lambda o: trim(regexp_replace(coalesce(o.text, ''), '\\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '{rules.NOISE_CELL}'))) AS ts FROM c)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Course versions as raw pages: a syllabus with sections and a calendar with a table of topics."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    section = lambda h, t: F.concat(F.lit("<h2>"), esc(h), F.lit("</h2><p>"), esc(t), F.lit("</p>"))
    units = F.array_join(F.transform(F.coalesce("units", F.array()), lambda u: section(u["title"], u["text"])), "")
    syllabus = F.concat(F.lit("<nav>menu</nav><script>var x = 1;</script>"), section(F.lit("Course overview"), F.col("objectives")), section(F.lit("Prerequisites"), F.col("prerequisites")), section(F.lit("Grading policy"), F.lit("Two exams count.")), units)
    rows = F.array_join(F.transform("outcomes", lambda o, i: F.concat(F.lit("<tr><td>"), i.cast("string"), F.lit("</td><td>"), esc(o["text"]), F.lit("</td></tr>"))), "")
    calendar = F.concat(F.lit("<table><tr><th>SES #</th><th>TOPICS</th></tr>"), F.coalesce(rows, F.lit("")), F.lit("</table>"))
    return versions(spark, d).select("id", syllabus.alias("syllabus"), calendar.alias("calendar"))


@query(f"WITH {CTE}, {_WEB} SELECT c.id, length(coalesce(pre, '')) AS n_pre, length(coalesce(body, '')) AS n_body, md5(coalesce(body, '')) AS body_hash, coalesce(len(ts), 0) AS n_topics, array_to_string(list_sort(coalesce(ts, [])), '|') AS topics FROM c LEFT JOIN wp USING (id) LEFT JOIN wt USING (id)")
def web_courses(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages to course records: kept sections, prerequisites apart, topics of the calendar's table."""
    w = W.page_courses(_pages(spark, d))
    return w.select(F.col("key").alias("id"), F.length("prerequisites_text").cast("bigint").alias("n_pre"), F.length("syllabus_text").cast("bigint").alias("n_body"), F.md5("syllabus_text").alias("body_hash"), F.size("lecture_topics").cast("bigint").alias("n_topics"), F.array_join(F.array_sort("lecture_topics"), "|").alias("topics"))


@query(f"SELECT DISTINCT doc_id, length({_CLEAN.format('text')}) AS n, md5({_CLEAN.format('text')}) AS hash FROM documents")
def web_clean(spark: SparkSession, d: str) -> DataFrame:
    t = C.clean_page_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("hash")).distinct()


@query(f"WITH d AS (SELECT DISTINCT doc_id, text FROM documents) SELECT doc_id, {_NW.format('text')} AS n_words FROM d WHERE {_NW.format('text')} >= 50 QUALIFY row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY doc_id) = 1")
def web_quality(spark: SparkSession, d: str) -> DataFrame:
    """Documents of fifty words or more, each text once."""
    g = W.good_texts(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")
    return g.select("doc_id", W.word_count(F.col("text")).cast("bigint").alias("n_words"))


@query(f"WITH d AS (SELECT DISTINCT doc_id, text FROM documents), w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS ws FROM d) SELECT doc_id, len(ws) AS n, md5(array_to_string(ws, ' ')) AS hash FROM w")
def web_content_words(spark: SparkSession, d: str) -> DataFrame:
    w = W.content_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", "text").distinct().select("doc_id", F.size(w).cast("bigint").alias("n"), F.md5(F.array_join(w, " ")).alias("hash"))


@query(f"WITH {CTE} SELECT coalesce(u.title, '') AS heading, count(*) AS n, regexp_matches(lower(coalesce(u.title, '')), '{rules.KEEP_SECTION}') OR NOT regexp_matches(lower(coalesce(u.title, '')), '{rules.DROP_SECTION}') AS kept FROM (SELECT unnest(units) AS u FROM c) GROUP BY ALL")
def web_kept_headings(spark: SparkSession, d: str) -> DataFrame:
    h = versions(spark, d).select(F.explode("units.title").alias("t")).select(F.coalesce("t", F.lit("")).alias("heading"))
    return h.groupBy("heading").agg(F.count("*").alias("n")).withColumn("kept", C.keep_section(F.col("heading")))


@query(f"WITH {CTE}, t AS (SELECT id, code, concat_ws(' ', prerequisites, text_books, 'see 6.' || lpad((hash_ % 90)::VARCHAR, 2, '0'), code) AS x FROM (SELECT *, length(coalesce(course_name, '')) * 7 AS hash_ FROM c)) SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(x, '{rules.COURSE_REFERENCE}'), lambda r: r IS DISTINCT FROM code))), ' ') AS refs FROM t")
def web_course_refs(spark: SparkSession, d: str) -> DataFrame:
    """Course numbers that a version's fields (with one number added) name, without its own code."""
    n = F.length(F.coalesce("course_name", F.lit(""))) * 7 % 90
    x = F.concat_ws(" ", "prerequisites", "text_books", F.concat(F.lit("see 6."), F.lpad(n.cast("string"), 2, "0")), "code")
    return versions(spark, d).select("id", F.array_join(C.course_references(x, F.col("code")), " ").alias("refs"))


_TAGS = "tg0 AS (SELECT DISTINCT id, lower(trim(u.title)) AS tag FROM (SELECT id, unnest(units) AS u FROM c) WHERE trim(coalesce(u.title, '')) <> '')"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    t = versions(spark, d).select("id", F.explode("units.title").alias("t")).select("id", F.lower(F.trim("t")).alias("tag"))
    return t.filter("tag <> ''").distinct()


@query(f"WITH {CTE}, {_TAGS} SELECT tag, count(*) AS df, round(ln((SELECT count(DISTINCT id) FROM tg0) / count(*)), 6) AS idf, count(*) >= 8 AS label FROM tg0 GROUP BY 1")
def web_tag_support(spark: SparkSession, d: str) -> DataFrame:
    """Unit titles as tags: in how many versions, their idf, and whether they have the support of a label."""
    return W.tag_support(_tags(spark, d)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {CTE}, {_TAGS}, l AS (SELECT tag FROM tg0 GROUP BY 1 HAVING count(*) >= 8) SELECT count(DISTINCT id) AS tagged, count(*) AS tags, count(DISTINCT tag) AS distinct_tags, (SELECT count(*) FROM l) AS labels, (SELECT count(DISTINCT id) FROM tg0 SEMI JOIN l USING (tag)) AS labelled, round(count(*) / count(DISTINCT id), 6) AS mean_tags FROM tg0")
def web_stats(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of a tagged collection in one row."""
    t = _tags(spark, d)
    label = W.tag_support(t).filter("label").select("tag")
    a = t.agg(F.count_distinct("id").alias("tagged"), F.count("*").alias("tags"), F.count_distinct("tag").alias("distinct_tags"), F.round(F.count("*") / F.count_distinct("id"), 6).alias("mean_tags"))
    b = label.agg(F.count("*").alias("labels"))
    c = t.join(label, "tag", "left_semi").agg(F.count_distinct("id").alias("labelled"))
    return a.crossJoin(b).crossJoin(c).select("tagged", "tags", "distinct_tags", "labels", "labelled", "mean_tags")


@query("""WITH t AS (SELECT DISTINCT topic AS id, unnest(programmes) AS tag FROM emerging_topics), s AS (SELECT DISTINCT topic AS id, min(source) AS course FROM emerging_topics GROUP BY 1), i AS (SELECT tag, ln((SELECT count(DISTINCT id) FROM t) / count(*)) AS idf FROM t GROUP BY 1), x AS (SELECT id, tag, idf FROM t JOIN i USING (tag)), tot AS (SELECT id, sum(idf) AS total FROM x GROUP BY 1),
n AS (SELECT a.id AS id_a, b.id AS id_b, array_to_string(list_sort(list(DISTINCT a.tag)), '; ') AS shared, sum(a.idf) AS common FROM x a JOIN x b ON a.tag = b.tag AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b, shared, round(CASE WHEN sa.course = sb.course THEN 1.0 ELSE common / CASE WHEN ta.total + tb.total - common > 0 THEN ta.total + tb.total - common ELSE 1 END END, 6) AS score FROM n JOIN tot ta ON ta.id = id_a JOIN tot tb ON tb.id = id_b JOIN s sa ON sa.id = id_a JOIN s sb ON sb.id = id_b""")
def web_tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Emerging topics by the programmes they share: idf-weighted overlap, 1 for topics of one source."""
    e = table(spark, d, "emerging_topics")
    t = e.select(F.col("topic").alias("id"), F.explode("programmes").alias("tag")).distinct()
    s = e.groupBy(F.col("topic").alias("id")).agg(F.min("source").alias("course"))
    return T.tag_pairs(t, s).withColumn("score", F.round("score", 6))


_LEX = " UNION ALL ".join(f"SELECT '{t.replace(chr(39), chr(39) * 2)}' AS topic, doc_id, len(regexp_extract_all(text, '(?i)\\b(?:{p})')) AS n FROM d" for t, p in rules.TOPIC_LEXICON.items())


@query(f"WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents), l AS ({_LEX}) SELECT topic, count(*) AS n_documents, sum(n)::BIGINT AS mentions FROM l WHERE n > 0 GROUP BY 1")
def txt_lexicon_topics(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mentions of each topic of the lexicon, and so what share it finds."""
    x = table(spark, d, "documents").select("doc_id", "text").distinct().select("doc_id", F.explode(C.topics_in(F.col("text"))).alias("topic", "n"))
    return x.groupBy("topic").agg(F.count("*").alias("n_documents"), F.sum("n").alias("mentions"))


@query(r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents), s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM d),
w AS (SELECT doc_id, list_filter(list_transform(range(0, len(ss), 3), lambda i: array_to_string(ss[i + 1:i + 3], ' ')), lambda g: len(regexp_split_to_array(g, '\s+')) > 4)[1:40] AS gs FROM s)
SELECT doc_id, len(gs) AS n, md5(array_to_string(gs, '|')) AS hash FROM w""")
def txt_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three sentences of each document."""
    g = C.word_groups(F.col("text"))
    return table(spark, d, "documents").select("doc_id", "text").distinct().select("doc_id", F.size(g).cast("bigint").alias("n"), F.md5(F.array_join(g, "|")).alias("hash"))


@query(r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents), p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: len(regexp_split_to_array(x, ' ')) >= 4)[1:60] AS ps FROM d)
SELECT doc_id, len(ps) AS n_units, sum_ AS n_chars FROM (SELECT doc_id, ps, coalesce(list_sum(list_transform(ps, lambda x: length(x))), 0)::BIGINT AS sum_ FROM p)""")
def prs_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts as course records: the booklet template first, else a unit for each paragraph."""
    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    r = P.from_text(docs, "doc_id", "text")
    return r.select(F.col("key").cast("bigint").alias("doc_id"), F.size("units").cast("bigint").alias("n_units"), F.aggregate(F.transform("units", lambda u: F.length(u["text"]).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_chars"))


# ---- retrieval ----------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {CTE}, o AS (SELECT family, lower(regexp_replace(unnest(outcomes).text, '[^A-Za-z0-9]+', '', 'g')) AS k FROM e), rg AS (SELECT k, list_sort(list(DISTINCT family)) AS fs FROM o WHERE k <> '' GROUP BY 1) SELECT k AS query_key, len(fs) AS n_relevant, fs[1] AS first_family FROM rg""")
def ret_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Outcome statements as queries, and the families that state them: the relevant results."""
    o = enriched(spark, d).select("family", F.explode("outcomes.text").alias("t")).select("family", F.lower(F.regexp_replace("t", "[^A-Za-z0-9]+", "")).alias("query_key")).filter("query_key <> ''")
    return o.groupBy("query_key").agg(F.count_distinct("family").alias("n_relevant"), F.min("family").alias("first_family"))


_COS = """cn AS (SELECT canonical_name AS name, any_value(concat_ws(' ', former_name, department)) AS content FROM course_catalog GROUP BY 1), pw AS (SELECT phrase, unnest(list_distinct(regexp_extract_all(lower(phrase), '[a-z0-9]+'))) AS t FROM ps), pn AS (SELECT phrase, count(*) AS np FROM pw GROUP BY 1),
nw AS (SELECT name, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) AS t FROM cn), nn AS (SELECT name, count(*) AS nn FROM nw GROUP BY 1), kw AS (SELECT name, unnest(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+'))) AS t FROM cn), kn AS (SELECT name, count(*) AS nn FROM kw GROUP BY 1),
s1 AS (SELECT phrase, name, count(*) / sqrt(any_value(np) * any_value(nn)) AS s FROM pw JOIN nw USING (t) JOIN pn USING (phrase) JOIN nn USING (name) GROUP BY ALL), s2 AS (SELECT phrase, name, count(*) / sqrt(any_value(np) * any_value(nn)) AS s FROM pw JOIN kw USING (t) JOIN pn USING (phrase) JOIN kn USING (name) GROUP BY ALL),
b AS (SELECT phrase, name, round(greatest(coalesce(s1.s, 0), CASE WHEN s2.s IS NOT NULL THEN 0.8::DOUBLE * s2.s + 0.1::DOUBLE ELSE 0 END), 9) AS score FROM s1 FULL JOIN s2 USING (phrase, name)), r AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY score DESC, name) = 1)"""


@query(f"""WITH ps AS (SELECT DISTINCT trim(course_name) AS phrase FROM courses_small WHERE trim(course_name) <> ''), {_COS} SELECT ps.phrase, r.name, round(score, 6) AS score FROM ps LEFT JOIN r USING (phrase)""")
def ret_catalog_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Typed names against names, former names and departments of the catalogue."""
    k = table(spark, d, "course_catalog").groupBy(F.col("canonical_name").alias("name")).agg(F.any_value(F.concat_ws(" ", "former_name", "department")).alias("content"))
    ph = table(spark, d, "courses_small").select(F.trim("course_name").alias("phrase")).filter("phrase <> ''")
    return T.catalogue_resolve(ph, k).withColumn("score", F.round("score", 6))


_BODY = "list_distinct(regexp_extract_all(lower(coalesce(u.text, '')), '[a-z0-9]+'))"
_ALIGN = f"""pr AS (SELECT id AS id_a, lead(id) OVER (PARTITION BY family ORDER BY ay, id) AS id_b FROM e), ua AS (SELECT id, i, u, regexp_replace(lower(coalesce(u.title, '')), '[^a-z0-9]+', '', 'g') AS k, {_BODY} AS w FROM (SELECT id, generate_subscripts(units, 1) AS i, unnest(units) AS u FROM c)), uf AS (SELECT id, i, k, w, count(*) OVER (PARTITION BY id, k) AS n FROM ua WHERE len(w) >= 5),
kn AS (SELECT pr.id_a, pr.id_b, a.i, a.k, a.w FROM pr JOIN uf a ON a.id = pr.id_a AND a.n = 1 AND a.k <> '' JOIN uf b ON b.id = pr.id_b AND b.n = 1 AND b.k = a.k), sc AS (SELECT kn.id_a, kn.id_b, kn.i, b.i AS j, b.k = kn.k AS own, round(len(list_intersect(kn.w, b.w)) / greatest(1, len(list_distinct(list_concat(kn.w, b.w)))), 9) AS s FROM kn JOIN uf b ON b.id = kn.id_b),
st2 AS (SELECT *, max(s) FILTER (WHERE own) OVER (PARTITION BY id_a, id_b, i) AS t, count(*) OVER (PARTITION BY id_a, id_b, i) AS n FROM sc), al AS (SELECT id_a, id_b, i, max(j) FILTER (WHERE own) AS j, 1 + count_if(s > t) + 0.5::DOUBLE * (count_if(s = t) - 1) AS rank, max(n) AS candidates FROM st2 WHERE n >= 3 GROUP BY ALL)"""


def _alignment(spark: SparkSession, d: str) -> DataFrame:
    e = enriched(spark, d)
    p = e.select(F.col("id").alias("id_a"), F.lead("id").over(Window.partitionBy("family").orderBy("ay", "id")).alias("id_b")).filter("id_b is not null")
    u = e.select("id", F.posexplode("units").alias("i", "u")).select("id", (F.col("i") + 1).cast("bigint").alias("i"), reduced(F.coalesce("u.title", F.lit(""))).alias("title_key"), F.array_distinct(words_of(F.col("u.text"))).alias("w")).filter("size(w) >= 5")
    return T.unit_alignment(p, u)


@query(f"WITH {CTE}, {_ALIGN.replace('regexp_replace(lower(coalesce(u.title', 'regexp_replace(replace(lower(coalesce(u.title').replace(chr(39) + chr(39) + ')), ' + chr(39) + '[^a-z0-9]+', chr(39) + chr(39) + ')), ' + chr(39) + '&' + chr(39) + ', ' + chr(39) + 'and' + chr(39) + '), ' + chr(39) + '[^a-z0-9]+')} SELECT id_a, id_b, i, j, rank, candidates FROM al")
def evl_unit_alignment(spark: SparkSession, d: str) -> DataFrame:
    """How the unit of the same title ranks by word overlap among the units of the next version."""
    return _alignment(spark, d)


@query(r"""WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS q, q.label = i.label AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, i.e), 9) DESC, i.vec_id) AS r FROM v q JOIN v i ON q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0),
h AS (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY r) AS k FROM p WHERE rel), m AS (SELECT q, min(r) AS f, avg(k / r) AS ap FROM h GROUP BY 1) SELECT count(*) AS queries, round(avg(1.0::DOUBLE / f), 6) AS mrr, round(avg((f <= 1)::INT), 6) AS r1, round(avg((f <= 5)::INT), 6) AS r5, round(avg(ap), 6) AS map FROM m""")
def evl_same_course(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector against all others: how the vectors of its own label rank."""
    from syllaweave.operators.vectors import nearest

    v = table(spark, d, "embeddings").select(F.lit(0).cast("bigint").alias("g"), F.col("label").cast("bigint").alias("label"), "vec_id", F.col("embedding").alias("vec"))
    q = v.filter("vec_id % 100 = 0").select("g", F.col("vec_id").alias("q"), F.col("label").alias("own"), "vec")
    s = nearest(q, v.select("g", F.col("vec_id").alias("bucket"), "vec_id", "vec"), "g", "q", "bucket", "vec_id", "vec").filter("q <> ix")  # each item is a bucket: all scores of the query set
    s = s.join(v.select(F.col("vec_id").alias("ix"), "label"), "ix").join(q.select("q", "own"), "q")
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("sim", 9)), "ix"))).filter("label = own")
    h = r.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("r"))).groupBy("q").agg(F.min("r").alias("f"), F.avg(F.col("k") / F.col("r")).alias("ap"))
    hit = lambda k: F.round(F.avg((F.col("f") <= k).cast("double")), 6)
    return h.agg(F.count("*").alias("queries"), F.round(F.avg(1.0 / F.col("f")), 6).alias("mrr"), hit(1).alias("r1"), hit(5).alias("r5"), F.round(F.avg("ap"), 6).alias("map"))


_ST = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(?:ments?|ed|ing|es|s)$', '') ELSE w END)"
_QA = f"""dd AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_kind = 'handbook'), sx AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.;])\\s+', '\\1' || chr(31), 'g'), chr(31)) AS ss FROM dd), sn0 AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS pos, trim(unnest(ss)) AS sentence FROM sx), se AS (SELECT * FROM sn0 WHERE len(regexp_split_to_array(sentence, '\\s+')) >= 3),
tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest({_ST.format('sentence')}) AS term FROM se) GROUP BY ALL), ln_ AS (SELECT doc_id, pos, sum(tf) AS l, count(*) AS n_s FROM tf GROUP BY ALL), sz AS (SELECT count(*) AS n, avg(l) AS mean FROM ln_),
d0 AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS i0 FROM tf, sz GROUP BY term, n), d1 AS (SELECT term, CASE WHEN i0 < 0 THEN 0.25::DOUBLE * (SELECT avg(i0) FROM d0) ELSE i0 END AS idf FROM d0),
qs AS (SELECT item_no, term, count(*) AS qw FROM (SELECT item_no, unnest({_ST.format('text')}) AS term FROM (SELECT DISTINCT item_no, text FROM heldout_items)) GROUP BY ALL), qn AS (SELECT item_no, count(*) AS n_q FROM qs GROUP BY 1),
ht AS (SELECT item_no, doc_id, pos, sum(qw * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))) AS kw, count(*) AS c, any_value(n_s) AS n_s FROM tf JOIN qs USING (term) JOIN d1 USING (term) JOIN ln_ USING (doc_id, pos), sz GROUP BY ALL),
fs AS (SELECT item_no, doc_id, pos, round(0.6::DOUBLE * CASE WHEN max(kw) OVER (PARTITION BY item_no) > 0 THEN kw / max(kw) OVER (PARTITION BY item_no) ELSE kw END + 0.4::DOUBLE * c / sqrt(n_s * n_q), 9) AS score FROM ht JOIN qn USING (item_no))"""


@query(f"WITH {_QA} SELECT item_no, doc_id, pos, sentence, round(score, 6) AS score FROM (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id, pos) = 1) JOIN se USING (doc_id, pos)")
def ret_answers(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of the handbooks that answers each test passage best, quoted with its source."""
    docs = table(spark, d, "documents").filter("doc_kind = 'handbook'").select("doc_id", "text").distinct()
    a = T.answers(docs, "doc_id", "text", table(spark, d, "heldout_items").select("item_no", "text").distinct(), "item_no", "text")
    return a.select("item_no", "doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence", F.round("score", 6).alias("score"))
