"""Queries of the lexical operators over documents, test passages and course versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from syllaweave.functions import course as C
from syllaweave.functions.text import jaccard, words_of
from syllaweave.operators import lexical as L
from syllaweave.operators.text_pairs import text_pairs
from syllaweave.plans.catalog_queries import CTE, enriched, versions
from syllaweave.session import written
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


_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS.split())
_TERMS = f"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9]{{{{2,}}}}'), lambda w: w NOT IN ({_STOP}))"


def _terms(x: str) -> str:
    return _TERMS.replace("{{", "{").replace("}}", "}").replace("{0}", x).replace("{{2,}}", "{2,}")


def _tf(rel: str, key: str, text: str) -> str:
    return f"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({_terms(text)}) AS term FROM {rel}) GROUP BY {key}, term"


_BIGRAMS = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
_DOC_TFIDF = f"""dw AS (SELECT doc_id, source, {_terms('text')} AS ws FROM documents),
tf AS (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest({_BIGRAMS}) AS term FROM dw) GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf, nd GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.8::DOUBLE * n),
raw AS (SELECT tf.*, df.df, (1 + ln(tf)) * (ln((1.0 + n)::DOUBLE / (1.0 + df)::DOUBLE) + 1) AS w0 FROM tf JOIN df USING (term), nd),
w AS (SELECT source, doc_id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY source, doc_id)) AS w FROM raw)"""


@query(f"WITH {_DOC_TFIDF} SELECT a.source, a.doc_id AS doc_a, b.doc_id AS doc_b, round(sum(a.w * b.w), 6) AS sim FROM w a JOIN w b ON a.source = b.source AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.5")
def ov_tfidf_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = text_pairs(table(spark, d, "documents"), "doc_id", "source", F.col("text"), 0.5, ngrams=2)
    return p.select("source", "doc_a", "doc_b", F.round("sim", 6).alias("sim"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', coalesce(objectives, ''), array_to_string(list_transform(outcomes, lambda o: o.text), ' '), array_to_string(list_transform(units, lambda u: u.text), ' '))), '[a-z0-9]+'), lambda w: length(w) >= 3))"


@query(f"""WITH {CTE}, v AS (SELECT family, id, {_WORDS} AS ws FROM e QUALIFY row_number() OVER (PARTITION BY family ORDER BY ay DESC, id DESC) <= 4)
SELECT a.family, a.id AS id_a, b.id AS id_b, round(len(list_intersect(a.ws, b.ws))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.ws, b.ws)))), 6) AS jaccard FROM v a JOIN v b ON a.family = b.family AND a.id < b.id""")
def ov_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of the up to four latest versions of each family (a comparison of at most six pairs a family)."""
    w = Window.partitionBy("family").orderBy(F.desc("ay"), F.desc("id"))
    v = enriched(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 4")
    v = v.select("family", "id", F.array_distinct(F.filter(words_of(C.course_text()), lambda x: F.length(x) >= 3)).alias("ws"))
    a, b = v.alias("a"), v.alias("b")
    return a.join(b, "family").filter("a.id < b.id").select("family", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.round(jaccard(F.col("a.ws"), F.col("b.ws")), 6).alias("jaccard"))


_BM25 = f"""tf AS ({_tf('documents', 'doc_id', 'text')}), ln_ AS (SELECT doc_id, sum(tf) AS l FROM tf GROUP BY 1), sz AS (SELECT count(*) AS n, avg(l) AS mean FROM ln_),
d0 AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS i0 FROM tf, sz GROUP BY term, n),
d1 AS (SELECT term, CASE WHEN i0 < 0 THEN 0.25::DOUBLE * (SELECT avg(i0) FROM d0) ELSE i0 END AS idf FROM d0),
bw AS (SELECT doc_id, term, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean)) AS w FROM tf JOIN d1 USING (term) JOIN ln_ USING (doc_id), sz),
q AS ({_tf('heldout_items', 'item_no', 'text')}),
bs AS (SELECT item_no, doc_id, sum(tf * w) AS score FROM q JOIN bw USING (term) GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bs QUALIFY rank <= 10)"""
_TFIDF_Q = f"""tt AS ({_tf('documents', 'doc_id', 'text')}), nn AS (SELECT count(*) AS n FROM documents), tdf AS (SELECT term, count(*) AS df FROM tt, nn GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.8::DOUBLE * n),
t0 AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n)::DOUBLE / (1.0 + df)::DOUBLE) + 1) AS w0 FROM tt JOIN tdf USING (term), nn), tw AS (SELECT doc_id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) AS w FROM t0),
tq AS ({_tf('heldout_items', 'item_no', 'text')}), q0 AS (SELECT item_no, term, (1 + ln(tf)) * (ln((1.0 + n)::DOUBLE / (1.0 + df)::DOUBLE) + 1) AS w0 FROM tq JOIN tdf USING (term), nn), qw AS (SELECT item_no, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY item_no)) AS w FROM q0),
ts AS (SELECT item_no, doc_id, sum(qw.w * tw.w) AS score FROM qw JOIN tw USING (term) GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ts QUALIFY rank <= 10)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "heldout_items").select("item_no", "text").distinct()


def _counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term counts of the documents (a stage table, read by every ranking) and of the test passages, and the passages' terms."""
    tf = written(L.counts(table(spark, d, "documents"), ["doc_id"], F.col("text")), "terms")
    q = L.counts(_items(spark, d), ["item_no"], F.col("text"))
    return tf, q, q.select("term").distinct()


def _bm25(tf: DataFrame, q: DataFrame, only: DataFrame) -> DataFrame:
    return L.best_documents(q.withColumnRenamed("tf", "w"), L.bm25(tf, "doc_id", only=only), "item_no", "doc_id", 10)


def _tfidf(tf: DataFrame, q: DataFrame, only: DataFrame, n: int) -> DataFrame:
    return L.best_documents(L.tfidf(q, ["item_no"], n, fit=tf), L.tfidf(tf, ["doc_id"], n, only=only), "item_no", "doc_id", 10)


@query(f"WITH {_BM25} SELECT item_no, doc_id, rank, round(round(score, 9), 6) AS score FROM br")
def ret_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(*_counts(spark, d)).select("item_no", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_TFIDF_Q} SELECT item_no, doc_id, rank, round(round(score, 9), 6) AS score FROM tr")
def ov_find_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf(*_counts(spark, d), table(spark, d, "documents").count()).select("item_no", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25}, {_TFIDF_Q}, u AS (SELECT item_no, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM br UNION ALL SELECT item_no, doc_id, 1.0::DOUBLE / (60 + rank) FROM tr) SELECT item_no, doc_id, round(sum(s), 9) AS score FROM u GROUP BY ALL")
def ret_rrf(spark: SparkSession, d: str) -> DataFrame:
    c = _counts(spark, d)
    return L.fuse([_bm25(*c), _tfidf(*c, table(spark, d, "documents").count())], "item_no", "doc_id").withColumn("score", F.round("score", 9))


@query(f"WITH {_BM25}, {_TFIDF_Q}, u AS (SELECT item_no, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM br UNION ALL SELECT item_no, doc_id, 1.0::DOUBLE / (60 + rank) FROM tr), f AS (SELECT item_no, doc_id, round(sum(s), 9) AS score FROM u GROUP BY ALL) SELECT item_no, doc_id, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5")
def ret_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents for each test passage, fused from keyword and vector ranking."""
    return L.top(ret_rrf(spark, d), "item_no", "doc_id", 5).select("item_no", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH tf AS (SELECT doc_kind, term, count(*) AS n FROM (SELECT doc_kind, unnest({_terms('text')}) AS term FROM documents) GROUP BY ALL), t AS (SELECT sum(n) AS total FROM tf), k AS (SELECT count(DISTINCT doc_kind) AS k FROM documents),
s AS (SELECT doc_kind, term, round(n::DOUBLE / sum(n) OVER (PARTITION BY doc_kind) * ln(1 + total::DOUBLE / sum(n) OVER (PARTITION BY term) / k), 9) AS score FROM tf, t, k)
SELECT doc_kind, term, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_kind ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 5""")
def txt_ctfidf_by_kind(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    k = docs.select("doc_kind").distinct().count()
    s = L.class_terms(L.counts(docs, ["doc_kind"], F.col("text")), "doc_kind", k).withColumn("score", F.round("score", 9))
    return L.top(s, "doc_kind", "term", 5).select("doc_kind", "term", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH tf AS ({_tf('(SELECT DISTINCT doc_id, text FROM documents)', 'doc_id', 'text')}), x AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h, tf FROM tf),
v AS (SELECT doc_id, (h % 256)::INT AS dim, sum(CASE WHEN (h // 256) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(tf))) AS v FROM x GROUP BY ALL HAVING abs(v) > 1e-9)
SELECT doc_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS v FROM v""")
def vec_hash_encode(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a hashed vector, its dimensions as rows."""
    v = L.hashed_vectors(L.counts(table(spark, d, "documents").select("doc_id", "text").distinct(), ["doc_id"], F.col("text")), "doc_id")
    return v.select("doc_id", "dim", F.round("v", 6).alias("v"))


_SPLIT = r"list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_SPLIT} AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(0, (ceil(greatest(len(ws) - 100, 0) / 75.0) * 75 + 1)::BIGINT, 75)) AS i FROM w WHERE len(ws) > 0)
SELECT doc_id, (i // 75)::BIGINT AS part, array_to_string(ws[i + 1:i + 100], ' ') AS passage FROM s""")
def txt_passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(C.passages(F.col("text"))).alias("part", "passage")).withColumn("part", F.col("part").cast("bigint"))


@query(f"""WITH {CTE}, u AS (SELECT id, unnest(units).text AS t FROM c), p AS (SELECT id, unnest(regexp_split_to_array(coalesce(t, ''), '[,;:.()]|\\bv/s\\b|\\bvs\\.?\\b')) AS x FROM u), q AS (SELECT id, trim(regexp_replace(trim(x), '^[ \\-–]+|[ \\-–]+$', '', 'g')) AS x0, regexp_replace(trim(x), '^[ \\-–]+|[ \\-–]+$', '', 'g') AS topic FROM p)
SELECT topic, count(*) AS n, count(DISTINCT id) AS n_versions FROM q WHERE length(topic) > 3 AND len(regexp_split_to_array(topic, '\\s+')) <= 12 GROUP BY 1""")
def txt_unit_topics(spark: SparkSession, d: str) -> DataFrame:
    t = versions(spark, d).select("id", F.explode("units.text").alias("t")).select("id", F.explode(C.unit_topics(F.col("t"))).alias("topic"))
    return t.groupBy("topic").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_versions"))


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')), '^\s*(?:[-*•]|\d+[.)])\s*', '')) AS x FROM documents WHERE doc_kind = 'job_description'),
k AS (SELECT * FROM l WHERE x <> '' AND NOT regexp_matches(x, '(?i)^(?:role|responsibilities|requirements|synthetic sample|about|location|salary)\b') AND NOT ends_with(x, ':')),
s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(x, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)))) AS requirement FROM k)
SELECT doc_id, requirement FROM s WHERE len(list_filter(regexp_split_to_array(requirement, '\s+'), lambda w: w <> '')) >= 5""")
def txt_requirements(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").filter("doc_kind = 'job_description'")
    return j.select("doc_id", F.explode(C.requirements(F.col("text"))).alias("requirement"))


@query(f"SELECT doc_id, array_to_string(({_SPLIT})[1:12], ' ') || CASE WHEN len({_SPLIT}) > 12 THEN ' ...' ELSE '' END AS cut FROM documents")
def txt_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.first_words(F.col("text"), 12, " ...").alias("cut"))


_CHUNKS = """CASE WHEN len(units) > 0 THEN list_transform(units, lambda u: {'label': coalesce(nullif(u.title, ''), array_to_string((list_filter(regexp_split_to_array(trim(coalesce(u.text, '')), '\\s+'), lambda w: w <> ''))[1:8], ' ')), 'text': u.text})
WHEN len(outcomes) > 0 THEN list_transform(outcomes, lambda o: {'label': substr(o.text, 1, 60), 'text': o.text}) WHEN coalesce(objectives, '') <> '' THEN [{'label': 'objectives', 'text': objectives}] ELSE [] END"""


@query(f"WITH {CTE}, x AS (SELECT id, {_CHUNKS} AS ch FROM c) SELECT id, generate_subscripts(ch, 1)::BIGINT AS chunk, unnest(ch).label AS label, length(unnest(ch).text)::BIGINT AS n FROM x")
def txt_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = versions(spark, d).select("id", F.posexplode(C.chunks()).alias("i", "c"))
    return x.select("id", (F.col("i") + 1).cast("bigint").alias("chunk"), "c.label", F.length("c.text").cast("bigint").alias("n"))
