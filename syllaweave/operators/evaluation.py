"""Label-free tests of detectors, threshold grids, label merging and the outcome classifier."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from syllaweave.functions import course as C
from syllaweave.functions.text import words_of
from syllaweave.operators.prerequisites import flags


def threshold_grid(df: DataFrame, score: str, positive: Column, negative: Column, grid: list[float]) -> DataFrame:
    """``(tau, recall, false_alarm, gain)`` of every threshold of ``grid``; NULL rates without cases of a kind.

    Scores are bucketed against the sorted grid first, so rows aren't copied for each threshold.
    """
    taus = sorted(set(grid))
    bucket = sum(((F.col(score) >= t).cast("int") for t in taus), F.lit(0))
    per = df.groupBy(bucket.alias("b")).agg(F.count_if(positive).alias("p"), F.count_if(negative).alias("n"))
    levels = df.sparkSession.createDataFrame(list(enumerate(taus, 1)), "k int, tau double")
    x = levels.join(per, F.col("b") >= F.col("k"), "left").groupBy("tau").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    total = per.agg(F.nullif(F.sum("p"), F.lit(0)).alias("tp"), F.nullif(F.sum("n"), F.lit(0)).alias("tn"))
    r, a = F.col("p") / F.col("tp"), F.col("n") / F.col("tn")
    return x.crossJoin(F.broadcast(total)).select("tau", r.alias("recall"), a.alias("false_alarm"), (r - a).alias("gain"))


def removal_test(cases: DataFrame, names: DataFrame, first: DataFrame) -> DataFrame:
    """One row: of the removal cases, the share flagged once the family is gone, and the share flagged while it is there.

    ``cases`` has ``programme, family, sem, phrase, phrase_key, removed_family``. A case only loses its own family, so all
    cases are checked at once: a schedule without the family is the schedule with its row of the case left out.
    """
    key = ["programme", "family", "sem", "phrase"]
    intact = flags(cases.withColumn("course_name", F.lit("")), names, first).select(*key).distinct().withColumn("there", F.lit(1))
    r = cases.join(names, "phrase_key", "left").join(first.withColumnRenamed("family", "resolved_family"), ["programme", "resolved_family"], "left")
    gone = F.col("resolved_family").isNull() | (F.col("resolved_family") == F.col("removed_family")) | F.col("first_sem").isNull() | (F.col("first_sem") >= F.col("sem"))
    own = F.coalesce(F.col("resolved_family") == F.col("family"), F.lit(False))
    j = r.withColumn("gone", (gone & ~own).cast("int")).join(intact, key, "left")
    return j.agg(F.count("*").alias("cases"), F.avg("gone").alias("removal_recall"), F.avg(F.coalesce("there", F.lit(0))).alias("intact_alarm"))


def inject_units(units: DataFrame, group: str, owner: str, text: str, n: int, seed: int = 42) -> DataFrame:
    """``(group, source_owner, target_owner, text)``: ``n`` units of each group copied into another owner of it.

    Units are taken in the order of a seeded hash; the target is the next owner in that order (a sampling operator).
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(owner).cast("string"), F.col(text)))
    w = Window.partitionBy(group).orderBy(h, owner)
    x = units.filter(F.col(text).isNotNull()).withColumn("_n", F.row_number().over(w)).withColumn("_t", F.lead(owner).over(w))
    return x.filter((F.col("_n") <= n) & (F.col("_t") != F.col(owner))).select(group, F.col(owner).alias("source_owner"), F.col("_t").alias("target_owner"), text)


def merge_passes(items: DataFrame, passes: list[DataFrame], key: str) -> DataFrame:
    """Items with ``pass1 .. passN``; an item that a pass lacks has NULL there, repeated rows of a pass count once."""
    out = items
    for i, p in enumerate(passes, 1):
        out = out.join(p.groupBy(key).agg(F.min("label").alias(f"pass{i}")), key, "left")
    return out


def outcome_classifier(tagged: DataFrame, statements: DataFrame, verb_map: DataFrame, text: str = "text", features: int = 4096) -> DataFrame:
    """``(text, level, by)``: the level of the learned verb, else of the lexicon, else of a fitted model.

    ``tagged`` has ``text, y``; ``verb_map`` has ``verb, level``. The model is a multinomial logistic regression with
    balanced class weights over hashed words; without tagged statements the third level is the fallback.
    """
    tf = HashingTF(inputCol="w", outputCol="features", numFeatures=features)
    train = tagged.select(F.col("y").cast("double").alias("label"), words_of(F.col("text")).alias("w"))
    by_class = train.groupBy("label").agg(F.count("*").alias("c"))
    classes = by_class.count()
    s = statements.select(F.col(text).alias("text")).distinct().withColumns({"verb": C.first_word(F.col("text")), "lexicon": C.lexicon_level(F.col("text")), "w": words_of(F.col("text"))})
    if classes < 2:
        model = s.withColumn("model", F.lit(3))
    else:
        total = by_class.agg(F.sum("c").alias("n"))
        weighted = train.join(F.broadcast(by_class), "label").crossJoin(F.broadcast(total)).withColumn("weight", F.col("n") / (classes * F.col("c")))
        fitted = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30, family="multinomial").fit(tf.transform(weighted))
        p = fitted.transform(tf.transform(s))
        model = p.withColumn("model", F.col("prediction").cast("int")).withColumn("sure", F.array_max(vector_to_array("probability"))).drop("features", "rawPrediction", "probability", "prediction", "sure")
    m = model.join(F.broadcast(verb_map.select("verb", F.col("level").alias("learned"))), "verb", "left") if verb_map.limit(50_001).count() <= 50_000 else model.join(verb_map.select("verb", F.col("level").alias("learned")), "verb", "left")
    kind = F.when(F.col("learned").isNotNull(), "learned").when(F.col("lexicon").isNotNull(), "lexicon").otherwise("model")
    return m.select("text", F.coalesce("learned", "lexicon", "model").cast("int").alias("level"), kind.alias("by"))
