"""Queries of the operators for training data, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from syllaweave.llm import canonical, consensus, cross_split as cs, leakage, long_repeats, near_duplicates as nd, packing, splits
from syllaweave.llm.oracle import ORACLE  # noqa: F401
from syllaweave.functions import course
from syllaweave.functions.text import reduced
from syllaweave.plans.packed_queries import prerequisite_values
from syllaweave.session import small
from syllaweave.sources.tables import table

NEAR = 0.75


def version_text() -> Column:
    return F.concat_ws(" ", F.col("units.text"), F.col("outcomes.text"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return nd.near_duplicates(table(spark, d, "courses_small"), "id", version_text(), NEAR)


def typed_names(spark: SparkSession, d: str) -> DataFrame:
    """(id, field, pos, value): course names, and each value of the prerequisites."""
    c = table(spark, d, "courses_small")
    names = c.filter(F.trim("course_name") != "").select("id", F.lit("course_name").alias("field"), F.lit(1).cast("bigint").alias("pos"), F.col("course_name").alias("value")).distinct()
    return names.unionByName(prerequisite_values(spark, d).select("id", F.lit("prerequisites").alias("field"), "pos", "value"))


def p3_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every typed name with the catalogue entry it means (0: none), the edits needed and the stage that found it."""
    k = table(spark, d, "course_catalog")
    entries = k.select(F.col("catalog_no").alias("entry"), F.col("canonical_name").alias("name"), F.lit(0).alias("rank")).unionByName(k.select(F.col("catalog_no").alias("entry"), F.col("former_name").alias("name"), F.lit(1).alias("rank")))
    return canonical.map_values(typed_names(spark, d), "value", entries).withColumnRenamed("entry", "catalog_no")


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """The assignment in one row: versions, groups, groups that stand on two sides, and the largest distance of a share from its target."""
    a = p2_assignment(spark, d).select("id", "group", "split").distinct()
    torn = a.groupBy("group").agg(F.count_distinct("split").alias("n")).agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("torn"))
    shares = a.groupBy("split").agg(F.count("*").alias("n"))
    total = a.agg(F.count("*").alias("n_versions"), F.count_distinct("id").alias("n_ids"))
    target = F.lit(0.0)
    for s, p in SHARES.items():
        target = F.when(F.col("split") == s, F.lit(p)).otherwise(target)
    off = shares.crossJoin(F.broadcast(total)).agg((F.max(F.abs(F.col("n") / F.col("n_versions") - target)) < 0.02).alias("near_target"))
    return total.crossJoin(torn).crossJoin(off).select("n_versions", "n_ids", "n_groups", "torn", "near_target")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    exact = table(spark, d, "course_catalog").select(reduced(F.col("canonical_name")).alias("key")).distinct()
    m = p3_mapped(spark, d).withColumn("key", reduced(F.col("value")))
    return m.join(small(exact), "key", "left_anti").select("id", "field", "pos", "catalog_no").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nd.key_pairs(*_versions(spark, d)).select(F.col("key_a").alias("id_a"), F.col("key_b").alias("id_b")).distinct()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each version: the least version with the same words, the least of its group (connected classes), its number of links."""
    g = nd.groups(*_versions(spark, d))
    return g.withColumnsRenamed({"key": "id", "class_key": "class_id", "group_key": "group_id"})


def _units_across(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "course_membership").select(F.col("item").alias("id"), F.lower(F.trim("split")).alias("split")).distinct()
    v = table(spark, d, "courses_small").select("id", F.col("units.text").alias("texts")).filter(F.size("texts") > 0)
    r = v.join(m.filter(F.col("split").isin("train", "val", "test")), "id").select("id", (F.col("split") == "train").alias("train"), F.posexplode("texts").alias("i", "text"))
    return cs.record_pairs(*cs.cross_split(r.select("id", (F.col("i") + 1).alias("unit"), "train", "text"), NEAR))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("train_id") < F.col("id")
    a, b = F.struct(F.col("train_id").alias("id"), F.col("train_unit").alias("unit")), F.struct("id", "unit")
    p = _units_across(spark, d).select(F.when(first, a).otherwise(b).alias("a"), F.when(first, b).otherwise(a).alias("b"))
    return p.select(F.col("a.id").alias("id_a"), F.col("a.unit").alias("unit_a"), F.col("b.id").alias("id_b"), F.col("b.unit").alias("unit_b")).distinct()


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Units of val and test versions that stand in a train version too, by split, source and course key."""
    m = table(spark, d, "course_membership").select(F.col("item").alias("id"), F.lower(F.trim("split")).alias("split")).distinct()
    c = table(spark, d, "courses_small").select("id", "source", "course_key").dropDuplicates(["id"])
    hit = _units_across(spark, d).groupBy("id", "unit").agg(F.max("fraction").alias("fraction"), F.countDistinct("train_id").alias("n_train"))
    return hit.join(m, "id").join(c, "id").groupBy("split", "source", "course_key").agg(F.count("*").alias("n_units"), F.countDistinct("id").alias("n_versions"), F.sum("n_train").alias("n_train_versions"), F.round(F.avg("fraction"), 6).alias("avg_fraction"))


SHARES = {"train": 0.6, "val": 0.2, "test": 0.2}


def p2_assignment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "courses_small")
    a = splits.assign(c, "id", course.name_key(F.col("course_key"), F.col("course_name")), course.code_key(F.col("code")), SHARES)
    return a.join(c.select(F.col("id").alias("key"), "code", course.year_key(F.col("academic_year")).alias("academic_year")).distinct(), "key").withColumnRenamed("key", "id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_assignment(spark, d).filter(~F.col("code").eqNullSafe(F.col("group_code"))).select("id", "group_code").distinct()


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the splits reach, in each academic year and over all."""
    by = p2_assignment(spark, d).select("id", "split", "academic_year").distinct().groupBy("academic_year", "split").agg(F.count("*").alias("n"))
    every = by.groupBy("split").agg(F.sum("n").alias("n")).select(F.lit("all").alias("academic_year"), "split", "n")
    w = Window.partitionBy("academic_year")
    return by.unionByName(every).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


LABELS = ["correct", "wrong"]
PASSES = [(f"pass{i}", f"pass{i}_by") for i in (1, 2, 3)]


def _skill_votes(spark: SparkSession, d: str) -> DataFrame:
    return consensus.votes(table(spark, d, "jdskills_llm"), "item", PASSES, LABELS)


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each item: the supported label, the model's label with its probability, and what is stored."""
    s = consensus.supported(table(spark, d, "jdskills_llm"), "item", [p for p, _ in PASSES], "consensus", LABELS)
    fitted = consensus.fit(_skill_votes(spark, d), LABELS)
    model = fitted.posterior.select("item", F.col("label").alias("model_label"), F.round("probability", 6).alias("probability"))
    return s.join(model, "item", "left")


#: A prior so strong that all raters stay about equally reliable and all classes about equally frequent: an item's posterior
#: then follows the numbers of its votes. Counts still move it (a tie by 1e-6 from some 4,000 items on), so no result takes it.
TIED = {"diagonal": 4e9, "off": 1e9, "share": 1e9}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose stored consensus isn't the label that two passes or more give, else uncertain; counted, so exact at any size."""
    s = consensus.supported(table(spark, d, "jdskills_llm"), "item", [p for p, _ in PASSES], "consensus", LABELS)
    return s.filter(F.col("stored") != F.col("label")).select("item", "label").distinct()


def p6_raters(spark: SparkSession, d: str) -> DataFrame:
    r = consensus.fit(_skill_votes(spark, d), LABELS).raters
    return r.select("rater", "n_votes", *(F.round(c, 4).alias(c) for c in ("reliability", "low", "high")))


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.krippendorff(_skill_votes(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    p = packing.pack(table(spark, d, "documents"), "doc_id", packing.token_count(F.col("text")))
    return p.withColumnRenamed("key", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).filter("pieces > 1").select("doc_id").distinct()


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens laid in, and the share of their room that is used."""
    per = p7_containers(spark, d).groupBy("container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * 1024), 6).alias("fill"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """The containers in one row: documents and tokens laid in, containers over 1,024 tokens, smaller documents divided, tokens missing or doubled, room used."""
    p = p7_containers(spark, d)
    used = p.groupBy("container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"))
    doc = p.groupBy("doc_id").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n"), F.max("token_to").alias("last"), F.min("token_from").alias("first"), F.count("*").alias("parts"))
    d1 = doc.agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.count_if((F.col("parts") > 1) & (F.col("n") <= 1024)).alias("divided"), F.count_if((F.col("n") != F.col("last")) | (F.col("first") != 0)).alias("wrong"))
    d2 = used.agg(F.count_if(F.col("used") > 1024).alias("overfull"), (F.sum("used") / (F.count("*") * 1024) > 0.95).alias("filled"))
    return d1.crossJoin(d2)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    hits = leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_no", "text")
    return hits.select(F.col("key").alias("doc_id"), F.col("item").alias("item_no"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """For each test item that leaked: in how many documents."""
    return p8_found(spark, d).groupBy("item_no").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = long_repeats.document_pairs(*long_repeats.shared_stretches(table(spark, d, "documents"), "doc_id", "text"))
    return pairs.select(F.col("key_a").alias("doc_a"), F.col("key_b").alias("doc_b")).distinct()


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands elsewhere too, in stretches of 400 characters or more."""
    return long_repeats.shared_share(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document of 400 characters or more: the least document with the same text, and the number of links."""
    members, found = long_repeats.shared_stretches(table(spark, d, "documents"), "doc_id", "text")
    return long_repeats.linked(members, found).withColumnsRenamed({"key": "doc_id", "class_key": "class_doc"})


QUERIES = {f.__name__: f for f in (p2_found, p2_assignment, p2_shares, p2_check, p3_found, p3_mapped, p4_found, p4_groups, p5_found, p5_overlaps, p6_found, p6_labels, p6_raters, p6_agreement, p7_found, p7_containers, p7_fill, p7_check, p8_found, p8_items, p9_found, p9_shared, p9_groups)}
