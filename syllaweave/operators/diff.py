"""Differences of two snapshots of a collection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from syllaweave.functions.text import reduced


def by_name(snap: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(programme, ay, next_ay, name_key, family_a, family_b, change)`` for every name of either snapshot.

    ``change`` is retained, removed or added; of equal names in one snapshot the last family counts.
    """
    s = snap.select("programme", "ay", reduced(F.col("course_name")).alias("name_key"), "family").groupBy("programme", "ay", "name_key").agg(F.max("family").alias("family"))
    p = pairs.select("programme", "ay", "next_ay")
    a = p.join(s, ["programme", "ay"]).select("programme", "ay", "next_ay", "name_key", F.col("family").alias("family_a"))
    b = p.join(s.withColumnRenamed("ay", "next_ay"), ["programme", "next_ay"]).select("programme", "ay", "next_ay", "name_key", F.col("family").alias("family_b"))
    j = a.join(b, ["programme", "ay", "next_ay", "name_key"], "full_outer")
    return j.withColumn("change", F.when(F.col("family_b").isNull(), "removed").when(F.col("family_a").isNull(), "added").otherwise("retained"))


def true_changes(snap: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(programme, ay, next_ay, family, change)`` of families that only one of the two snapshots has."""
    s, p = snap.select("programme", "ay", "family").distinct(), pairs.select("programme", "ay", "next_ay")
    a = p.join(s, ["programme", "ay"]).withColumn("a", F.lit(1))
    b = p.join(s.withColumnRenamed("ay", "next_ay"), ["programme", "next_ay"]).withColumn("b", F.lit(1))
    j = a.join(b, ["programme", "ay", "next_ay", "family"], "full_outer").filter("a is null or b is null")
    return j.select("programme", "ay", "next_ay", "family", F.when(F.col("b").isNull(), "removed").otherwise("added").alias("change"))


def score(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of pooled precision and recall of removed and added claims; NULL where nothing was claimed or true."""
    by = ["programme", "ay", "next_ay", "family", "change"]
    c = claims.filter("change <> 'retained'").select(*by[:3], F.coalesce("family_a", "family_b").alias("family"), "change").distinct().withColumn("claimed", F.lit(1))
    j = c.join(truth.withColumn("real", F.lit(1)), by, "full_outer")
    n = j.agg(F.count_if((F.col("claimed") == 1) & (F.col("real") == 1)).alias("tp"), F.count("claimed").alias("claimed"), F.count("real").alias("real"))
    return n.select("tp", "claimed", "real", (F.col("tp") / F.nullif("claimed", F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("real", F.lit(0))).alias("recall"))


def greedy_match(candidates: DataFrame, group: list[str], schema: str) -> DataFrame:
    """One-to-one matches of each group: the best pair first, ties to the larger names, as ``(*group, a, b, s)``.

    ``candidates`` has ``a, b, s``. A group's candidates (the unmatched courses of one programme and year pair) are
    matched in one task; groups are spread over tasks.
    """
    def match(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["s", "a", "b"], ascending=False, kind="stable")
        taken_a, taken_b, keep = set(), set(), []
        for i, a, b in zip(x.index, x["a"], x["b"]):
            if a not in taken_a and b not in taken_b:
                taken_a.add(a)
                taken_b.add(b)
                keep.append(i)
        return x.loc[keep, [*group, "a", "b", "s"]]

    return candidates.select(*group, "a", "b", "s").groupBy(*group).applyInPandas(match, schema)
