"""Queries of the packed-values operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from syllaweave.operators.packed import split_packed
from syllaweave.sources.tables import table


def catalog_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "course_catalog")
    return c.select(F.explode(F.array("canonical_name", "former_name")).alias("name")).filter(F.col("name").isNotNull())


def prerequisite_values(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "courses_small"), "prerequisites", "id", catalog_names(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return prerequisite_values(spark, d).select("id", "pos", "value_key").distinct()


def p1_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each value is named, and at which positions."""
    return prerequisite_values(spark, d).groupBy("value_key").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_versions"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


QUERIES = {"p1_found": p1_found, "p1_value_counts": p1_value_counts}
ORACLE: dict[str, str] = {}
