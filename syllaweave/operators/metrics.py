"""Evaluation measures over (group, label, score) rows, as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def average_rank(score: str, by: list[str]) -> Column:
    """Rank from 1, ties averaged."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(score)) + (F.count("*").over(Window.partitionBy(*by, score)) - 1) / 2


def spearman(df: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    """``(*by, spearman)``; NULL where one side doesn't vary."""
    r = df.withColumn("_a", average_rank(y, by)).withColumn("_b", average_rank(s, by))
    return r.groupBy(*by).agg((F.covar_pop("_a", "_b") / F.nullif(F.stddev_pop("_a") * F.stddev_pop("_b"), F.lit(0.0))).alias("spearman"))


def auc(df: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    """``(*by, auc)`` of boolean ``y`` by average ranks; NULL with one class."""
    r = df.withColumn("_r", average_rank(s, by))
    n1, n0 = F.count_if(F.col(y)), F.count_if(~F.col(y))
    return r.groupBy(*by).agg(F.when((n1 > 0) & (n0 > 0), (F.sum(F.when(F.col(y), F.col("_r"))) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def curve(df: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    """``(*by, s, tp, predicted, positives)`` at every distinct score as threshold; tied scores are one step."""
    steps = df.groupBy(*by, F.col(s).alias("s")).agg(F.count_if(F.col(y)).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    down = w.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*by, "s", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("predicted"), F.sum("p").over(w).alias("positives"), "p")


def average_precision(df: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    """``(*by, ap)``: precision at each step, weighted by the recall it adds."""
    c = curve(df, y, s, by)
    return c.groupBy(*by).agg(F.sum(F.col("tp") / F.col("predicted") * F.col("p") / F.nullif("positives", F.lit(0))).alias("ap"))


def best_threshold(df: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    """``(*by, threshold, f1)`` of the largest F1; of equal ones the smallest threshold."""
    c = curve(df, y, s, by).withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(F.col("predicted") + F.col("positives"), F.lit(0)), F.lit(0.0)))
    return c.groupBy(*by).agg(F.max_by(F.struct("s", "f1"), F.struct(F.round("f1", 12), -F.col("s"))).alias("b")).select(*by, F.col("b.s").alias("threshold"), F.col("b.f1").alias("f1"))


def prf(df: DataFrame, y: str, predicted: Column, by: list[str]) -> DataFrame:
    """``(*by, tp, fp, fn, precision, recall, f1)``; NULL where a denominator is zero."""
    p = df.withColumn("_p", predicted)
    n = p.groupBy(*by).agg(F.count_if(F.col(y) & F.col("_p")).alias("tp"), F.count_if(~F.col(y) & F.col("_p")).alias("fp"), F.count_if(F.col(y) & ~F.col("_p")).alias("fn"))
    safe = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return n.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)})


def classification(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """``(*by, n, accuracy, within_one, macro_f1)`` of ordinal labels; the mean F1 is over the classes present in ``y``."""
    cell = df.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("c"))
    whole = cell.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)) / F.sum("c")).alias("accuracy"), (F.sum(F.when(F.abs(F.col("y") - F.col("p")) <= 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("within_one"))
    true = cell.groupBy(*by, F.col("y").alias("k")).agg(F.sum("c").alias("t"), F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"))
    said = cell.groupBy(*by, F.col("p").alias("k")).agg(F.sum("c").alias("s"))
    f1 = true.join(said, [*by, "k"], "left").groupBy(*by).agg(F.avg(2 * F.col("tp") / (F.col("t") + F.coalesce("s", F.lit(0)))).alias("macro_f1"))
    return whole.join(f1, by)


def calibration(df: DataFrame, y: str, p: str, bins: int = 5) -> DataFrame:
    """One row ``(brier, ece)`` of probabilities ``p`` for boolean ``y``; the last bin holds 1."""
    x = df.select(F.col(y).cast("double").alias("y"), F.col(p).alias("p")).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    b = x.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return b.agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def rank_metrics(first: DataFrame, rank: str) -> DataFrame:
    """One row of MRR@10, recall at 1, 5 and 10 and the mean discounted gain of the first relevant rank (NULL: none)."""
    r = F.col(rank)
    hit = lambda k: F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0)))
    return first.agg(F.count("*").alias("n"), F.avg(F.when(r <= 10, 1.0 / r).otherwise(0.0)).alias("mrr"), hit(1).alias("r1"), hit(5).alias("r5"), hit(10).alias("r10"), F.avg(F.when(r <= 10, 1.0 / F.log2(r + 1)).otherwise(0.0)).alias("ndcg"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(n, agreement, kappa)`` of two raters' labels; rows without both are left out, kappa NULL with one class."""
    x = df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    cell = x.groupBy("a", "b").agg(F.count("*").alias("c"))
    n = cell.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    ra, rb = cell.groupBy("a").agg(F.sum("c").alias("ca")), cell.groupBy(F.col("b").alias("a")).agg(F.sum("c").alias("cb"))
    chance = ra.join(rb, "a").agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("e"))
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return n.crossJoin(F.broadcast(chance)).select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))  # one row each


def bootstrap_mean(df: DataFrame, value: str, group: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """``(value, low, high)``: the mean with a 95 % interval that resamples whole groups.

    Groups are reduced to a sum and a count first; every replicate gives a group a Poisson(1) weight from a hash, so a
    replicate is a weighted sum and no row is copied.
    """
    per = df.groupBy(group).agg(F.sum(value).cast("double").alias("s"), F.count(value).alias("c"))
    reps = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col(group).cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    edges, total, p = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += p
        edges.append(total)
        p /= k + 1
    weight = sum(((u >= e).cast("int") for e in edges), F.lit(0))
    m = reps.withColumn("w", weight).groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("c")), F.lit(0))).alias("m"))
    point = per.agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("value"))
    return point.crossJoin(F.broadcast(m.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))))


def paired_difference(df: DataFrame, base: str, new: str, group: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """:func:`bootstrap_mean` of ``new - base`` with a verdict."""
    b = bootstrap_mean(df.select(group, (F.col(new) - F.col(base)).alias("_d")), "_d", group, n, seed)
    return b.withColumn("verdict", F.when(F.col("low") > 0, "improved").when(F.col("high") < 0, "worse").otherwise("no clear difference"))
