"""Fitted models: a logistic model with folds by group, and one model for each label of a text."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from syllaweave.functions.text import words_of
from syllaweave.operators.metrics import auc


def _fold(group: str, folds: int, seed: int = 42):
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))), 1, 8), 16, 10).cast("bigint") % folds


def fit_logistic(df: DataFrame, y: str, features: list[str], group: str, folds: int = 5, c: float = 1.0) -> DataFrame:
    """One row: coefficients, intercept, rows and the AUC over folds that keep groups whole; NULL with one class.

    The penalty is that of ``C = c`` on unscaled features: ``1 / (c n)`` of the mean loss.
    """
    x = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("_fold", _fold(group, folds)))
    n = x.count()
    spark = df.sparkSession
    schema = ", ".join(f"{f} double" for f in features) + ", intercept double, n bigint, cv_auc double"
    if n == 0 or x.select(y).distinct().count() < 2:
        return spark.createDataFrame([(*[None] * len(features), None, n, None)], schema)
    make = lambda rows: LogisticRegression(labelCol=y, regParam=1.0 / (c * max(rows, 1)), standardization=False, maxIter=100)
    model = make(n).fit(x)
    parts = None
    for k in range(folds):
        train = x.filter(F.col("_fold") != k)
        if train.select(y).distinct().count() < 2:
            continue
        p = make(train.count()).fit(train).transform(x.filter(F.col("_fold") == k)).select((F.col(y) > 0).alias("y"), F.element_at(vector_to_array(F.col("probability")), 2).alias("s"))
        parts = p if parts is None else parts.unionByName(p)
    score = auc(parts.withColumn("_all", F.lit(1)), "y", "s", ["_all"]).first()["auc"] if parts is not None else None
    return spark.createDataFrame([(*[round(float(v), 6) for v in model.coefficients], round(float(model.intercept), 6), n, None if score is None else round(score, 6))], schema)


def one_against_rest(df: DataFrame, text: str, labels: str, names: list[str], group: str, penalties: tuple[float, ...] = (0.01, 0.1), features: int = 2048) -> DataFrame:
    """``(label, n, penalty, f1)`` and a row ``micro`` of one logistic model for each label over hashed words.

    Groups with a hash of zero in five are the test; of the rest a quarter chooses the penalty. Labels that a part lacks
    give F1 zero. ``names`` are the labels that are modelled, a bounded list.
    """
    tf = HashingTF(inputCol="_w", outputCol="features", numFeatures=features)
    x = tf.transform(df.withColumn("_w", words_of(F.col(text))).withColumn("_part", _fold(group, 5)))
    test, choose, train = x.filter("_part = 0"), x.filter("_part = 1"), x.filter("_part > 1")
    rows, tp, said, real = [], 0, 0, 0

    def counts(model, part: DataFrame) -> tuple[int, int, int]:  # noqa: ANN001
        p = model.transform(part).agg(F.count_if((F.col("prediction") > 0) & (F.col("_y") > 0)), F.count_if(F.col("prediction") > 0), F.count_if(F.col("_y") > 0)).first()
        return p[0], p[1], p[2]

    f1 = lambda c: 2 * c[0] / (c[1] + c[2]) if c[1] + c[2] else 0.0
    for name in names:
        of = lambda part: part.withColumn("_y", F.array_contains(labels, name).cast("double"))  # noqa: E731, B023
        if of(train).select("_y").distinct().count() < 2:
            rows.append((name, 0, None, 0.0))
            continue
        fitted = [(LogisticRegression(labelCol="_y", regParam=r, maxIter=20).fit(of(train)), r) for r in penalties]
        best, penalty = max(fitted, key=lambda m: (f1(counts(m[0], of(choose))), -m[1]))
        c = counts(best, of(test))
        rows.append((name, c[2], penalty, round(f1(c), 6)))
        tp, said, real = tp + c[0], said + c[1], real + c[2]
    rows.append(("micro", real, None, round(f1((tp, said, real)), 6)))
    return df.sparkSession.createDataFrame(rows, "label string, n bigint, penalty double, f1 double")
