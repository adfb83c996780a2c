"""Lexical similarity and retrieval over long (doc, term, weight) tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from syllaweave.functions.text import let
from syllaweave.session import bounded_rows, small, written

#: English function words that carry no topic.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does "
    "doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most "
    "my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with you your yours"
)


def terms(text: Column, ngrams: int = 1) -> Column:
    """Words of two characters or more without function words; then runs of up to ``ngrams`` of them."""
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda x: ~x.isin(STOP_WORDS.split()))
    if ngrams == 1:
        return w
    return let(w, lambda x: F.concat(x, F.transform(F.filter(F.arrays_zip(x.alias("a"), F.slice(x, 2, 1 << 30).alias("b")), lambda p: p["b"].isNotNull()), lambda p: F.concat_ws(" ", p["a"], p["b"]))))


def counts(df: DataFrame, keys: list[str], text: Column, ngrams: int = 1, stop: bool = True) -> DataFrame:
    """``(*keys, term, tf)``; a row without words has no terms. Rows with equal keys add up. Without ``stop``, function words count too."""
    words = terms(text, ngrams) if stop else F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return df.select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def tfidf(tf: DataFrame, keys: list[str], n_docs: int, fit: DataFrame | None = None, min_df: int = 2, max_df: float = 0.8, only: DataFrame | None = None) -> DataFrame:
    """``(*keys, term, w, df)``: (1 + ln tf) x (ln((1 + n) / (1 + df)) + 1), unit length for each document.

    ``fit`` (default: ``tf`` itself) is what document frequencies are counted on; terms in fewer than ``min_df`` or more
    than the share ``max_df`` of its documents are left out. ``only`` (one column ``term``) are the terms whose weights
    are wanted: lengths are of whole documents, but other terms aren't carried on.
    """
    df = (fit if fit is not None else tf).groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    raw = tf.join(df, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1))
    if only is None:
        return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))).select(*keys, "term", "w", "df")
    length = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    return raw.join(small(only), "term", "left_semi").join(length, keys).select(*keys, "term", (F.col("w") / F.col("_l")).alias("w"), "df")


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, doc_a, doc_b, terms and weights of both) to (group, doc_a, doc_b, sim); terms are sorted hashes."""
    for rb in batches:
        ta, wa, tb, wb = rb.columns[3:]
        n = rb.num_rows
        na, nb = (np.diff(t.offsets.to_numpy()) for t in (ta, tb))
        # one sorted list of (pair, term) for each side
        ka, kb = (np.stack([np.repeat(np.arange(n), k), t.flatten().to_numpy()]) for k, t in ((na, ta), (nb, tb)))
        order = np.lexsort((np.concatenate([ka[1], kb[1]]), np.concatenate([ka[0], kb[0]])))
        pair, term = (np.concatenate([x, y])[order] for x, y in zip(ka, kb))
        w = np.concatenate([wa.flatten().to_numpy(), wb.flatten().to_numpy()])[order]
        both = np.flatnonzero((pair[1:] == pair[:-1]) & (term[1:] == term[:-1]))
        sim = np.bincount(pair[both], w[both] * w[both + 1], n)
        yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array(sim)], ["group", "doc_a", "doc_b", "sim"])


def cosine_pairs(w: DataFrame, doc: str, group: str, threshold: float) -> DataFrame:
    """``(group, doc_a, doc_b, sim)`` of documents of one group with cosine >= ``threshold``, complete.

    Terms of a document are ordered from rare to frequent; only its prefix is joined, up to where the rest is shorter
    than the threshold. Two documents that share no prefix term can't reach it, so frequent terms never meet all rows.
    A document's vector is one row of two arrays, and the dot products of a batch of pairs are one merge of them.
    """
    vector = w.select(group, doc, F.struct((-F.col("df")).alias("d"), F.xxhash64("term").alias("t"), "w").alias("x")).groupBy(group, doc).agg(F.collect_list("x").alias("x"))  # the terms of one document
    kinds = dict(w.dtypes)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = rb.column(2).flatten()
            d, t, v = (x.field(c).to_numpy() for c in ("d", "t", "w"))
            row = np.repeat(np.arange(rb.num_rows), np.diff(rb.column(2).offsets.to_numpy()))
            order = np.lexsort((t, d, row))[::-1]  # rare terms first, documents backwards
            r, sq = row[order], v[order] ** 2
            begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
            total = np.concatenate([[0.0], np.cumsum(sq)])
            size = np.diff(np.append(begin, len(r)))
            rest = np.repeat(total[begin + size], size) - total[:-1]  # the squared length of the term and all more frequent ones
            keep = np.zeros(len(r), bool)
            keep[order] = np.sqrt(np.maximum(rest, 0)) >= threshold - 1e-9
            count = np.bincount(row[keep], minlength=rb.num_rows)
            order = np.lexsort((t, row))
            at = rb.column(2).offsets.to_numpy() - rb.column(2).offsets.to_numpy()[0]
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(y)) for o, y in ((np.concatenate([[0], np.cumsum(count)]), t[keep]), (at, t[order]), (at, v[order]))]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), *lists], ["group", "doc", "prefix", "terms", "ws"])

    docs = written(vector.mapInArrow(prefixes, f"group {kinds[group]}, doc {kinds[doc]}, prefix array<bigint>, terms array<bigint>, ws array<double>"), "vectors")
    rows = docs.select("group", "doc", F.explode("prefix").alias("term"))
    a, b = rows.withColumnRenamed("doc", "doc_a"), rows.withColumnRenamed("doc", "doc_b")
    pairs = a.join(b, ["group", "term"]).filter("doc_a < doc_b").select("group", "doc_a", "doc_b").distinct()
    side = lambda x: docs.select("group", F.col("doc").alias(f"doc_{x}"), F.col("terms").alias(f"t_{x}"), F.col("ws").alias(f"w_{x}"))
    both = pairs.join(side("a"), ["group", "doc_a"]).join(side("b"), ["group", "doc_b"]).select("group", "doc_a", "doc_b", "t_a", "w_a", "t_b", "w_b")
    dots = both.mapInArrow(_dots, f"group {kinds[group]}, doc_a {kinds[doc]}, doc_b {kinds[doc]}, sim double")
    return dots.filter(F.col("sim") >= threshold).withColumnRenamed("group", group)


def scored(queries: DataFrame, weights: DataFrame, query: str, doc: str) -> DataFrame:
    """``(query, doc, score)``: sum of products over shared terms. Queries are the small side if they are few."""
    q = queries.select(query, "term", F.col("w").alias("qw"))
    return weights.select(doc, "term", "w").join(small(q), "term").groupBy(query, doc).agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def best_documents(queries: DataFrame, weights: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """``(query, doc, score, rank)``: the ``k`` documents of each query with the largest sum of products over shared terms.

    Scores are rounded to nine digits, ties go to the smaller document. Few queries are sent to the tasks, which keep the
    best ``k`` of a batch of documents for each query, so that only those are shuffled; many are joined term by term.
    Query and document are BIGINT; products are positive.
    """
    rows = bounded_rows(queries.select(F.col(query).cast("bigint"), "term", F.col("w").cast("double")))
    if rows is None:
        return top(scored(queries, weights, query, doc).withColumn("score", F.round("score", 9)), query, doc, k)
    names = sorted({r[0] for r in rows})
    terms = {t: i for i, t in enumerate(sorted({r[1] for r in rows}))}
    column = {q: i for i, q in enumerate(names)}
    postings = sorted((terms[t], column[q], w) for q, t, w in rows)
    edge = np.searchsorted([p[0] for p in postings], np.arange(len(terms) + 1))
    of_query, of_weight, number = np.array([p[1] for p in postings], np.int64), np.array([p[2] for p in postings]), np.array(names, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = rb.column(1).flatten()
            term, w = x.field("term").to_pylist(), x.field("w").to_numpy()
            at = np.array([terms.get(t, -1) for t in term], np.int64)
            row = np.repeat(np.arange(rb.num_rows), np.diff(rb.column(1).offsets.to_numpy()))
            keep = at >= 0
            at, w, row = at[keep], w[keep], row[keep]
            count = edge[at + 1] - edge[at]
            each = np.repeat(np.arange(len(at)), count)
            p = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + edge[at][each]
            score = np.round(np.bincount(row[each] * len(names) + of_query[p], w[each] * of_weight[p], rb.num_rows * len(names)).reshape(rb.num_rows, len(names)), 9)
            docs = rb.column(0).to_numpy()
            order = np.argsort(docs, kind="stable")
            best = order[np.argsort(-score[order], axis=0, kind="stable")[:k]]
            got = np.take_along_axis(score, best, 0)
            i, j = np.nonzero(got > 0)
            yield pa.RecordBatch.from_arrays([pa.array(number[j]), pa.array(docs[best[i, j]]), pa.array(got[i, j])], [query, doc, "score"])

    per = weights.groupBy(F.col(doc).cast("bigint").alias(doc)).agg(F.collect_list(F.struct("term", F.col("w").cast("double").alias("w"))).alias("x"))  # the query terms of one document
    return top(per.mapInArrow(run, f"{query} bigint, {doc} bigint, score double"), query, doc, k)


def top(scores: DataFrame, query: str, doc: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best documents of each query with their ``rank``; ties go to the smaller document."""
    w = Window.partitionBy(query).orderBy(F.desc(score), doc)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(tf: DataFrame, doc: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, only: DataFrame | None = None) -> DataFrame:
    """``(doc, term, w)``: the weight that one query occurrence of the term earns the document.

    idf is ln((n - df + 0.5) / (df + 0.5)); where that is negative, ``epsilon`` times the mean idf counts. ``only`` as in
    :func:`tfidf`.
    """
    length = tf.groupBy(doc).agg(F.sum("tf").alias("len"))
    size = length.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))  # one row of totals
    df = df.withColumn("idf0", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = df.agg(F.avg("idf0").alias("avg_idf"))
    df = df.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf0") < 0, epsilon * F.col("avg_idf")).otherwise(F.col("idf0")))
    if only is not None:
        df, tf = df.join(small(only), "term", "left_semi"), tf.join(small(only), "term", "left_semi")
    x = tf.join(df.select("term", "idf", "mean"), "term").join(length, doc)
    return x.select(doc, "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))).alias("w"))


def fuse(rankings: list[DataFrame], query: str, doc: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings with a ``rank`` column that starts at 1."""
    parts = [r.select(query, doc, (1.0 / (F.lit(k) + F.col("rank"))).alias("s")) for r in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(query, doc).agg(F.sum("s").alias("score"))


def class_terms(tf: DataFrame, cluster: str, k: int) -> DataFrame:
    """``(cluster, term, n, score)``: share of the term in its class times ln(1 + total / occurrences / classes)."""
    n = tf.groupBy(cluster, "term").agg(F.sum("tf").alias("n"))
    in_class, of_term = Window.partitionBy(cluster), Window.partitionBy("term")
    total = n.agg(F.sum("n").alias("total"))
    x = n.withColumn("c", F.sum("n").over(in_class)).withColumn("t", F.sum("n").over(of_term)).crossJoin(F.broadcast(total))
    return x.select(cluster, "term", "n", (F.col("n") / F.col("c") * F.log(1 + F.col("total") / F.col("t") / k)).alias("score"))


def hashed_vectors(tf: DataFrame, doc: str, dims: int = 256) -> DataFrame:
    """``(doc, dim, v)``: a deterministic stand-in for a sentence encoder: terms hashed to signed dimensions, unit length."""
    h = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint")
    x = tf.select(doc, (h % dims).cast("int").alias("dim"), F.when(F.floor(h / dims) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"), "tf")
    v = x.groupBy(doc, "dim").agg(F.sum(F.col("sign") * (1 + F.log("tf"))).alias("v")).filter("abs(v) > 1e-9")  # what cancels out is no dimension, whatever the order of the sum
    return v.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(doc))))


def dense(vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """``(key, vec ARRAY<DOUBLE>)`` of ``(key, dim, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, rb.num_rows, 1_000):
                part = rb.slice(at, 1_000)
                x = part.column(1).flatten()
                m = np.zeros((part.num_rows, dims))
                m[np.repeat(np.arange(part.num_rows), np.diff(part.column(1).offsets.to_numpy())), x.field("dim").to_numpy()] = x.field("v").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dims), pa.array(m.ravel()))], [key, "vec"])

    m = vectors.groupBy(key).agg(F.collect_list(F.struct("dim", "v")).alias("x"))
    return m.mapInArrow(run, f"{key} {dict(vectors.dtypes)[key]}, vec array<double>")
