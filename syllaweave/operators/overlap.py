"""Overlap of two records, over many pairs at once: directed best matches of their units, shared topics, features, fusion.

A record is a row of unit vectors; a pair of records is a row of two such arrays, multiplied in the task that joins them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from syllaweave.functions import course as C
from syllaweave.operators import lexical as L

#: Frozen values: means, scales and coefficients of the confidence model over raw features, and its intercept.
CONFIDENCE = {"tfidf": (0.0, 1.0, 1.5476), "soft": (0.0, 1.0, 1.6914), "max_unit": (0.0, 1.0, 2.2568)}
INTERCEPT = -3.0684
#: Frozen thresholds: a unit match, a substantial overlap, a duplicate unit.
UNIT_MATCH, SUBSTANTIAL, DUPLICATE = 0.55, 0.6648010611534119, 0.5483264923095703
DIMS = 256


def hashed_encoder(df: DataFrame) -> DataFrame:
    """``(key, text)`` to ``(key, vec)``: hashed terms of unit length, a stand-in for a sentence encoder; no words, no row."""
    return L.dense(L.hashed_vectors(L.counts(df, ["key"], F.col("text")), "key", DIMS), "key", DIMS)


def unit_vectors(courses: DataFrame, encode: Callable[[DataFrame], DataFrame] = hashed_encoder) -> DataFrame:
    """``(id, ix, label, vec)`` of the units (else outcomes, else objectives) of each course; each distinct text is encoded once.

    A text that the encoder gives nothing for has a vector of zeros.
    """
    u = courses.select("id", F.posexplode(C.chunks()).alias("ix", "c")).select("id", "ix", "c.label", F.coalesce("c.text", F.lit("")).alias("text")).withColumn("key", F.sha1("text"))
    v = encode(u.select("key", "text").dropDuplicates(["key"]))
    return u.join(v, "key", "left").select("id", "ix", "label", F.coalesce(F.col("vec").cast("array<double>"), F.array().cast("array<double>")).alias("vec"))


def by_record(units: DataFrame) -> DataFrame:
    """``(id, u)``: the units of a record as one array (the units of a course are a few dozen)."""
    return units.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ix", "label", F.col("vec").cast("array<double>").alias("vec")))).alias("u"))


def _joined(pairs: DataFrame, records: DataFrame) -> DataFrame:
    a, b = (records.select(F.col("id").alias(f"id_{x}"), F.col("u").alias(f"u_{x}")) for x in "ab")
    return pairs.select("id_a", "id_b").join(a, "id_a").join(b, "id_b").select("id_a", "id_b", "u_a", "u_b")


def _matrix(u: pa.Scalar) -> np.ndarray:
    """Unit vectors as rows; a unit without a vector is a row of zeros."""
    vec = u.values.field("vec")
    n = np.diff(vec.offsets.to_numpy())
    out = np.zeros((len(n), max(int(n.max(initial=0)), 1)))
    out[n > 0] = vec.flatten().to_numpy().reshape(int((n > 0).sum()), -1)
    return out


def _similar(a: pa.Scalar, b: pa.Scalar) -> np.ndarray:
    """Dot products to nine digits, so that thresholds don't depend on the order of a sum."""
    x, y = _matrix(a), _matrix(b)
    return np.round(x @ y.T, 9) if x.shape[1] == y.shape[1] else np.zeros((len(x), len(y)))


def pair_scores(pairs: DataFrame, units: DataFrame, tau: float = UNIT_MATCH) -> DataFrame:
    """``(id_a, id_b, cov_a, cov_b, overlap, soft, max_unit)`` of each pair; all zero where a record has no units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for k in range(rb.num_rows):
                s = _similar(rb.column(2)[k], rb.column(3)[k])
                a, b = s.max(1), s.max(0)
                ca, cb = float((a >= tau).mean()), float((b >= tau).mean())
                out.append((ca, cb, 2 * ca * cb / (ca + cb) if ca + cb else 0.0, float(a.mean() + b.mean()) / 2, float(s.max())))
            cols = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), *(pa.array(c, pa.float64()) for c in cols)], ["id_a", "id_b", *SCORES])

    found = _joined(pairs, by_record(units)).mapInArrow(run, "id_a string, id_b string, " + ", ".join(f"{c} double" for c in SCORES))
    return pairs.select("id_a", "id_b").join(found, ["id_a", "id_b"], "left").na.fill(0.0, SCORES)


SCORES = ["cov_a", "cov_b", "overlap", "soft", "max_unit"]


def pair_topics(pairs: DataFrame, units: DataFrame, tau: float = UNIT_MATCH, k: int = 10) -> DataFrame:
    """``(id_a, id_b, kind, place, topic, match, similarity)``: common topics (best first), and those of only one side in their order.

    At most ``k`` of each kind come out (the size of an answer). Equal similarities go to the earlier unit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for n in range(rb.num_rows):
                a, b = rb.column(2)[n], rb.column(3)[n]
                la, lb = (x.values.field("label").to_pylist() for x in (a, b))
                s = _similar(a, b)
                best_a, best_b = s.max(1), s.max(0)
                hits = [i for i in np.argsort(-best_a, kind="stable") if best_a[i] >= tau][:k]
                rows = [("common", la[i], lb[int(s[i].argmax())], float(best_a[i])) for i in hits]
                rows += [("only a", la[i], None, float(best_a[i])) for i in np.flatnonzero(best_a < tau)[:k]]
                rows += [("only b", lb[j], None, float(best_b[j])) for j in np.flatnonzero(best_b < tau)[:k]]
                place: dict[str, int] = {}
                for kind, topic, match, sim in rows:
                    place[kind] = place.get(kind, 0) + 1
                    out.append((rb.column(0)[n].as_py(), rb.column(1)[n].as_py(), kind, place[kind], topic, match, sim))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64()))], ["id_a", "id_b", "kind", "place", "topic", "match", "similarity"])

    return _joined(pairs, by_record(units)).mapInArrow(run, "id_a string, id_b string, kind string, place int, topic string, match string, similarity double")


def text_cosine(pairs: DataFrame, courses: DataFrame, fit: DataFrame) -> DataFrame:
    """``(id_a, id_b, tfidf)``: TF-IDF cosine of the courses' texts, with document frequencies of ``fit`` (ids of training courses)."""
    tf = L.counts(courses, ["id"], C.course_text())
    w = L.tfidf(tf, ["id"], fit.count(), fit=tf.join(fit.select("id"), "id", "left_semi"))
    v = w.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w"))).alias("x"))  # the terms of one course
    v = v.select("id", F.col("x.t").alias("t"), F.col("x.w").alias("w"))
    a, b = (v.select(F.col("id").alias(f"id_{s}"), F.col("t").alias(f"t_{s}"), F.col("w").alias(f"w_{s}")) for s in "ab")
    both = pairs.select("id_a", "id_b").join(a, "id_a").join(b, "id_b")
    dots = both.select(F.lit(0).alias("group"), F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"), "t_a", "w_a", "t_b", "w_b").mapInArrow(L._dots, "group int, doc_a string, doc_b string, sim double")
    return pairs.select("id_a", "id_b").join(dots.select(F.col("doc_a").alias("id_a"), F.col("doc_b").alias("id_b"), F.col("sim").alias("tfidf")), ["id_a", "id_b"], "left").na.fill(0.0, ["tfidf"])


def features(pairs: DataFrame, courses: DataFrame, fit: DataFrame, units: DataFrame, tau: float = UNIT_MATCH) -> DataFrame:
    """All scores of each pair with its confidence, the chance of any overlap under the frozen model."""
    from syllaweave.operators.vectors import logistic

    x = pair_scores(pairs, units, tau).join(text_cosine(pairs, courses, fit), ["id_a", "id_b"])
    return x.withColumn("confidence", logistic(CONFIDENCE, INTERCEPT))


def fused(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``fusion``: the mean place of ``tfidf`` and ``soft`` among those of reference pairs (shares that aren't above)."""
    from syllaweave.operators.vectors import empirical_cdf

    x = empirical_cdf(empirical_cdf(scores, "tfidf", reference.select("tfidf"), "_f1"), "soft", reference.select("soft"), "_f2")
    return x.withColumn("fusion", (F.col("_f1") + F.col("_f2")) / 2).drop("_f1", "_f2")


def best_hits(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best courses for each ``id_a`` by fusion, then confidence, then id (a top-k report)."""
    w = Window.partitionBy("id_a").orderBy(F.desc(F.round("fusion", 9)), F.desc(F.round("confidence", 9)), "id_b")
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def percent(c: Column) -> Column:
    return F.concat(F.bround(F.round(c * 100, 9), 0).cast("int").cast("string"), F.lit("%"))
