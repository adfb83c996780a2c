"""Web course pages: sections and tables to course records, quality filter, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from syllaweave.functions import rules
from syllaweave.functions.course import clean_page_text, keep_section
from syllaweave.operators.parse import html_sections, html_table_column


def page_courses(pages: DataFrame, key: str = "id", topic_header: str = "topic") -> DataFrame:
    """``(key, prerequisites_text, outcomes, syllabus_text, lecture_topics)`` of ``pages(key, syllabus, calendar)`` in HTML.

    Kept sections only; those about prerequisites are apart. Topics are the distinct cells of the topic columns of both
    pages in order, without holidays and exams; a course without any takes the calendar's kept sections into its text.
    Pages may be NULL.
    """
    def kept(page: str) -> DataFrame:
        s = html_sections(pages.filter(F.col(page).isNotNull()), key, page).withColumn("text", clean_page_text(F.col("text")))
        return s.filter(keep_section(F.col("heading"))).withColumn("page", F.lit(0 if page == "syllabus" else 1))

    topics = None
    for n, page in enumerate(("calendar", "syllabus")):
        t = html_table_column(pages.filter(F.col(page).isNotNull()), key, page, topic_header).filter(~F.col("cell").rlike(rules.NOISE_CELL)).withColumn("page", F.lit(n))
        topics = t if topics is None else topics.unionByName(t)
    listed = topics.groupBy("key").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("page", "position", "cell"))), lambda x: x["cell"])).alias("lecture_topics"))
    k = pages.select(F.col(key).cast("string").alias("key"))
    s = kept("syllabus").unionByName(kept("calendar").join(listed.select("key"), "key", "left_anti"))
    head = F.lower("heading")
    pre, out = head.contains("prereq"), head.rlike(rules.OUTCOME_SECTION)
    item = F.struct("page", "position", "text")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, item))), lambda x: x["text"]), " ")
    per = s.groupBy("key").agg(joined(pre).alias("prerequisites_text"), joined(~pre).alias("syllabus_text"), F.transform(F.sort_array(F.collect_list(F.when(out, item))), lambda x: x["text"]).alias("outcomes"))
    return k.join(per, "key", "left").join(listed, "key", "left").select("key", F.coalesce("prerequisites_text", F.lit("")).alias("prerequisites_text"), F.coalesce("outcomes", F.array().cast("array<string>")).alias("outcomes"), F.coalesce("syllabus_text", F.lit("")).alias("syllabus_text"), F.coalesce("lecture_topics", F.array().cast("array<string>")).alias("lecture_topics"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def good_texts(df: DataFrame, key: str, text: str, least: int = 50) -> DataFrame:
    """Rows of ``least`` words or more, each text (without case) once: the least key stays."""
    x = df.filter(word_count(F.col(text)) >= least).withColumn("_h", F.md5(F.lower(text)))
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy(key))).filter("_n = 1").drop("_h", "_n")


def content_words(text: Column) -> Column:
    """Lower-case words of two letters or more without function words, in order (not lemmatised: no lemmatiser is at hand)."""
    from syllaweave.operators.lexical import STOP_WORDS

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS.split()))


def tag_support(tags: DataFrame, least: int = 8) -> DataFrame:
    """``(tag, df, idf, label)`` of ``tags(id, tag)``: a tag of ``least`` records or more is a label."""
    n = tags.select("id").distinct().agg(F.count("*").alias("n"))
    per = tags.distinct().groupBy("tag").agg(F.count("*").alias("df"))
    return per.crossJoin(F.broadcast(n)).select("tag", "df", F.log(F.col("n") / F.col("df")).alias("idf"), (F.col("df") >= least).alias("label"))
