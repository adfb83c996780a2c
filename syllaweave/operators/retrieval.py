"""Retrieval over text units: answers quoted from passages, topic coverage, unit alignment, catalogue resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from syllaweave.functions.course import light_stem
from syllaweave.functions.text import words_of
from syllaweave.session import small


def long_words(c: Column) -> Column:
    return F.array_distinct(F.filter(words_of(c), lambda w: F.length(w) >= 3))


def topic_coverage(topics: DataFrame, units: DataFrame, tau: float, k: int = 5) -> DataFrame:
    """``(topic, programme, best, covered, evidence)``: the share of a topic's words that a unit of a listed programme holds.

    ``topics`` has ``topic, description, programmes``, ``units`` ``programme, id, i, text``. A programme without units has
    ``best`` 0. Words of three letters or more count; units meet topics over words, never each with each.
    """
    t = topics.select("topic", F.explode("programmes").alias("programme"), long_words(F.concat_ws(" ", "topic", "description")).alias("q"))
    asked = t.select("topic", "programme", F.size("q").alias("n"), F.explode("q").alias("t"))
    u = units.select("programme", "id", "i", F.explode(long_words(F.col("text"))).alias("t")).join(small(asked.select("programme", "t").distinct()), ["programme", "t"], "left_semi")
    s = u.join(small(asked), ["programme", "t"]).groupBy("topic", "programme", "id", "i").agg((F.count("*") / F.max("n")).alias("s"))
    w = Window.partitionBy("topic", "programme").orderBy(F.desc("s"), "id", "i")
    top = s.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    best = top.groupBy("topic", "programme").agg(F.max("s").alias("best"), F.sort_array(F.collect_list(F.struct("r", "id", "i"))).alias("evidence"))
    out = t.select("topic", "programme").distinct().join(best, ["topic", "programme"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return out.select("topic", "programme", "best", (F.col("best") >= tau).alias("covered"), "evidence")


def sentences(passages: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, sentence)`` of three words or more."""
    s = passages.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"(?<=[.;])\s+")).alias("pos", "sentence"))
    return s.withColumn("sentence", F.trim("sentence")).filter(F.size(F.split("sentence", r"\s+")) >= 3)


def answers(passages: DataFrame, key: str, text: str, questions: DataFrame, question: str, ask: str, beta: float = 0.6, similarity: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(question, key, pos, sentence, score)``: for each question the sentence that answers it best, quoted as it stands.

    A sentence scores ``beta`` x BM25 over light stems (over the question's best) plus ``1 - beta`` x similarity.
    ``similarity`` maps ``(question, key, pos, q, s)`` (the stems of both) to the same with ``sim``; by default the cosine
    of the stem sets. Ties go to the least key and position. A question that shares no word with a sentence has no answer.
    """
    from syllaweave.operators.lexical import bm25

    stems = lambda c: F.transform(words_of(c), light_stem)
    s = sentences(passages, key, text).withColumn("doc", F.xxhash64(key, "pos"))
    tf = s.select("doc", F.explode(stems(F.col("sentence"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    asked = questions.select(question, F.explode(stems(F.col(ask))).alias("term")).groupBy(question, "term").agg(F.count("*").alias("qw"))
    only = asked.select("term").distinct()
    hit = bm25(tf, "doc", only=only).join(small(asked), "term").groupBy(question, "doc").agg(F.sum(F.col("qw") * F.col("w")).alias("kw"), F.count("*").alias("common"))
    size = tf.groupBy("doc").agg(F.count("*").alias("n_s"))
    n_q = asked.groupBy(question).agg(F.count("*").alias("n_q"))
    x = hit.join(size, "doc").join(n_q, question)
    if similarity is None:
        x = x.withColumn("sim", F.col("common") / F.sqrt(F.col("n_s") * F.col("n_q")))
    else:
        x = similarity(x.join(s.select("doc", "sentence"), "doc").join(questions.select(question, ask), question)).drop("sentence", ask)
    top = F.max("kw").over(Window.partitionBy(question))
    x = x.withColumn("score", F.round(beta * F.when(top > 0, F.col("kw") / top).otherwise(F.col("kw")) + (1 - beta) * F.col("sim"), 9)).join(s, "doc")
    w = Window.partitionBy(question).orderBy(F.desc("score"), key, "pos")
    return x.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(question, key, "pos", "sentence", "score")


def search(mode: str, keyword: Callable[[], DataFrame], vector: Callable[[], DataFrame], query: str, doc: str) -> DataFrame:
    """Ranked documents by ``keyword``, by ``vector``, or by the fusion of both rankings (``hybrid``); only what is asked for is computed."""
    from syllaweave.operators.lexical import fuse, top

    if mode not in ("keyword", "vector", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "hybrid":
        return keyword() if mode == "keyword" else vector()
    return top(fuse([keyword(), vector()], query, doc).withColumn("score", F.round("score", 9)), query, doc, 10)


def rerank(hits: DataFrame, query: str, doc: str, score: Callable[[DataFrame], DataFrame], k: int = 10) -> DataFrame:
    """The first ``k`` hits of each query in the order of a second score: ``score`` adds ``sim`` to ``(query, doc, ...)``."""
    w = Window.partitionBy(query).orderBy(F.desc("sim"), "rank", doc)
    return score(hits.filter(F.col("rank") <= k)).withColumn("rank", F.row_number().over(w))


def unit_alignment(pairs: DataFrame, units: DataFrame, least: int = 3) -> DataFrame:
    """``(id_a, id_b, i, j, rank, candidates)``: how the counterpart of a unit ranks among the units of the other version.

    Units with the same title, unique on both sides, are the known counterparts. ``units`` has ``id, i, title_key, w`` (the
    words of its body, five or more); versions with fewer than ``least`` candidates are left out. Ties count half.
    """
    once = units.withColumn("_c", F.count("*").over(Window.partitionBy("id", "title_key")))
    a = units.join(once.filter("_c = 1 and title_key <> ''").select("id", "i", "title_key"), ["id", "i", "title_key"]).select(F.col("id").alias("id_a"), "i", "title_key", F.col("w").alias("wa"))
    b = units.select(F.col("id").alias("id_b"), F.col("i").alias("j"), F.col("title_key").alias("other"), F.col("w").alias("wb"))
    unique_b = once.filter("_c = 1 and title_key <> ''").select(F.col("id").alias("id_b"), "title_key")
    known = pairs.join(a, "id_a").join(unique_b, ["id_b", "title_key"])
    union = F.size(F.array_union("wa", "wb"))
    s = known.join(b, "id_b").select("id_a", "id_b", "i", "j", (F.col("title_key") == F.col("other")).alias("own"), F.round(F.size(F.array_intersect("wa", "wb")) / F.greatest(F.lit(1), union), 9).alias("s"))
    by = Window.partitionBy("id_a", "id_b", "i")
    s = s.withColumns({"true": F.max(F.when(F.col("own"), F.col("s"))).over(by), "candidates": F.count("*").over(by)}).filter(F.col("candidates") >= least)
    n = s.groupBy("id_a", "id_b", "i").agg(F.max(F.when(F.col("own"), F.col("j"))).alias("j"), (1 + F.count_if(F.col("s") > F.col("true")) + 0.5 * (F.count_if(F.col("s") == F.col("true")) - 1)).alias("rank"), F.max("candidates").alias("candidates"))
    return n.select("id_a", "id_b", "i", "j", "rank", "candidates")


def catalogue_resolve(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """``(phrase, name, score)``: the entry with the largest ``greatest(name similarity, 0.8 x content similarity + 0.1)``.

    ``names`` has ``name, content``; similarities are cosines of word sets, entries meet phrases over words. A phrase
    without a common word has NULL.
    """
    terms = lambda df, keys, c: df.select(*keys, F.explode(F.array_distinct(words_of(c))).alias("t"))
    p = terms(phrases.select("phrase").distinct(), ["phrase"], F.col("phrase"))
    n_p = p.groupBy("phrase").agg(F.count("*").alias("np"))

    def cosine(c: str) -> DataFrame:
        x = terms(names.select("name", c).distinct(), ["name"], F.col(c)).distinct()
        n = x.groupBy("name").agg(F.count("*").alias("nn"))
        return p.join(x, "t").groupBy("phrase", "name").agg(F.count("*").alias("c")).join(n_p, "phrase").join(n, "name").select("phrase", "name", (F.col("c") / F.sqrt(F.col("np") * F.col("nn"))).alias(f"s_{c}"))

    both = cosine("name").join(cosine("content"), ["phrase", "name"], "full_outer")
    score = F.greatest(F.coalesce("s_name", F.lit(0.0)), F.when(F.col("s_content").isNotNull(), 0.8 * F.col("s_content") + 0.1).otherwise(0.0))
    w = Window.partitionBy("phrase").orderBy(F.desc("score"), "name")
    best = both.withColumn("score", F.round(score, 9)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("phrase", "name", "score")
    return phrases.select("phrase").distinct().join(best, "phrase", "left")


def tag_pairs(tags: DataFrame, same: DataFrame) -> DataFrame:
    """``(id_a, id_b, shared, score)``: idf-weighted Jaccard of tag sets, for pairs that share a tag; 1 for pairs of one ``course``.

    ``tags`` has ``id, tag``; ``same`` has ``id, course``.
    """
    n = tags.select("id").distinct().agg(F.count("*").alias("n"))
    idf = tags.groupBy("tag").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("tag", F.log(F.col("n") / F.col("df")).alias("idf"))
    x = tags.join(idf, "tag")
    total = x.groupBy("id").agg(F.sum("idf").alias("total"))
    a, b = (x.select(F.col("id").alias(f"id_{s}"), "tag", "idf") for s in "ab")
    inner = a.join(b.drop("idf"), "tag").filter("id_a < id_b").groupBy("id_a", "id_b").agg(F.array_join(F.array_sort(F.collect_set("tag")), "; ").alias("shared"), F.sum("idf").alias("common"))
    side = lambda s: total.select(F.col("id").alias(f"id_{s}"), F.col("total").alias(f"t_{s}")).join(same.select(F.col("id").alias(f"id_{s}"), F.col("course").alias(f"c_{s}")), f"id_{s}")
    j = inner.join(side("a"), "id_a").join(side("b"), "id_b")
    union = F.col("t_a") + F.col("t_b") - F.col("common")
    return j.select("id_a", "id_b", "shared", F.when(F.col("c_a") == F.col("c_b"), 1.0).otherwise(F.col("common") / F.when(union > 0, union).otherwise(1.0)).alias("score"))
