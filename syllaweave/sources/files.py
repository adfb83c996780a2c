"""Sources and sinks: course records, page caches, labels, job descriptions, reference lists, metrics, embeddings."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from syllaweave.operators.parse import COURSE_SCHEMA
from syllaweave.session import written

COURSES = COURSE_SCHEMA + ", id string, source_files array<string>, n_source_files int"
PAGES = "path string, pages array<string>"
TOPICS = "status string, topics array<struct<topic: string, description: string, programmes: array<string>, source: string, verified: boolean, note: string>>"


def read_courses(spark: SparkSession, path: str) -> DataFrame:
    """Course records of JSON lines by a declared schema; fields a file lacks are NULL."""
    return spark.read.schema(COURSES).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label file, all columns as text; the empty string and ``None`` are NULL."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*(F.when(~F.col(f"`{c}`").isin("", "None"), F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_jobs(spark: SparkSession, glob: str) -> DataFrame:
    """``(id, text)`` of text files; the id is the file's stem."""
    t = spark.read.option("wholetext", True).text(glob)
    return t.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), F.col("value").alias("text"))


def read_topics(spark: SparkSession, path: str, verified_only: bool = True) -> DataFrame:
    t = spark.read.schema(TOPICS).option("multiLine", True).json(path).select(F.explode("topics").alias("t")).select("t.*")
    return t.filter("verified") if verified_only else t


def write_pages(pages: DataFrame, path: str) -> DataFrame:
    """Pages as a JSON-lines cache, and ``(files, pages, characters, unreadable)`` of it as one row; a path without pages counts as unreadable."""
    pages.select("path", "pages").write.mode("overwrite").json(path)
    n = F.greatest(F.size("pages"), F.lit(0))
    chars = F.aggregate(F.coalesce("pages", F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda s, p: s + F.length(F.coalesce(p, F.lit(""))))
    return read_pages(pages.sparkSession, path).agg(F.count("*").alias("files"), F.sum(n).alias("pages"), F.sum(chars).alias("characters"), F.count_if(n == 0).alias("unreadable"))


SKIPPED_NAMES = r"(?i)exam|question|paper"


def read_archives(spark: SparkSession, glob: str, extract: Callable[[str, bytes], list[str]], suffix: str = ".pdf", least: int = 200) -> DataFrame:
    """``(path, pages, status)`` of the files in zip archives: read, unreadable or scanned (no ``pages`` then).

    ``extract`` maps a name and its bytes to page texts (no PDF reader is shipped). Names that SKIPPED_NAMES matches and
    other suffixes are left out; a file whose first five pages hold fewer than ``least`` characters counts as scanned.
    Parts of a path lose their outer blanks.
    """
    skipped = re.compile(SKIPPED_NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for content in rows["content"]:
                out = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if not name.lower().endswith(suffix) or skipped.search(name.rsplit("/", 1)[-1]):
                            continue
                        path = "/".join(p.strip() for p in name.split("/"))
                        try:
                            pages = extract(name, z.read(name))
                        except Exception:  # noqa: BLE001
                            out.append((path, None, "unreadable"))
                            continue
                        scanned = sum(len(p) for p in pages[:5]) < least
                        out.append((path, None if scanned else pages, "scanned" if scanned else "read"))
                yield pd.DataFrame(out, columns=["path", "pages", "status"])

    return spark.read.format("binaryFile").load(glob).select("content").mapInPandas(run, PAGES + ", status string")


def docx_text(_: str, content: bytes) -> list[str]:
    """The text of a word-processor file as one page: a line for each paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    return [html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml))).strip()]


def write_audit(records: DataFrame, path: str, private: list[str]) -> DataFrame:
    """``records`` without the columns ``private``, which go to an audit folder with the id and are never published."""
    records.select("id", *private).write.mode("overwrite").parquet(path)
    return records.drop(*private)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines with one key each, in the order of their columns; NULL stays visible."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append_results(results: DataFrame, path: str, key: str) -> DataFrame:
    """Results added to a resumable job's folder, those already there left out; what the folder then holds."""
    spark = results.sparkSession
    there = _exists(spark, path)
    new = results.dropDuplicates([key])
    if there:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.schema(results.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def filled(templates: DataFrame, text: str, metrics: DataFrame) -> DataFrame:
    """``templates`` with every ``{{name:digits}}`` in ``text`` replaced by the metric's number with so many decimals.

    ``metrics`` has ``name, value``, a row for each metric of a report (a bounded list); an unknown name stays as it is.
    """
    m = metrics.groupBy("name").agg(F.max("value").cast("double").alias("value")).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_m"))
    marks = F.regexp_extract_all(F.col(text), F.lit(r"\{\{[^{}:]+:\d\}\}"), F.lit(0))

    def put(t: Column, mark: Column) -> Column:
        name, digits = F.regexp_extract(mark, r"\{\{([^:]+):", 1), F.regexp_extract(mark, r":(\d)", 1).cast("int")
        value = F.try_element_at("_m", name)
        return F.replace(t, mark, F.coalesce(F.call_function("format_number", value, F.concat(F.lit("#,##0"), F.when(digits > 0, F.concat(F.lit("."), F.repeat(F.lit("0"), digits))).otherwise(F.lit("")))), mark))

    return templates.crossJoin(F.broadcast(m)).withColumn(text, F.aggregate(F.array_distinct(marks), F.col(text), put)).drop("_m")


def write_courses(df: DataFrame, path: str) -> None:
    """Course records as Parquet, one folder for each academic year, so that a year's queries read only that folder."""
    df.withColumn("year", F.coalesce("academic_year", F.lit("unknown"))).repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header; arrays are joined by ``"; "``."""
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` counting its rows from 1 in the order of ``order`` (equal keys in any order, NULL first).

    Rows are laid out in sorted ranges; each range is numbered on its own and starts where the ranges before it end, so
    only one count for each range meets in one place.
    """
    parts = written(df.sort(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("_range").agg(F.count("*").alias("_c")).select("_range", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def write_parts(df: DataFrame, path: str, key: str, parts: int) -> None:
    """Items as JSON lines in ``parts`` folders of equal size (the last may be smaller), in the order of their keys, at any number of items."""
    size = max(1, -(-df.count() // parts))
    ranked = numbered(df, [key], "_n").withColumn("part", F.floor((F.col("_n") - 1) / size)).drop("_n")
    ranked.write.mode("overwrite").partitionBy("part").json(path)


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that a resumable job hasn't done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def cached_vectors(spark: SparkSession, texts: DataFrame, text: str, cache: str, model: str, encode) -> DataFrame:  # noqa: ANN001
    """``(sha1, vec)`` of each distinct text: from the cache, else encoded once and added to it.

    ``encode`` maps a DataFrame ``(sha1, text)`` to ``(sha1, vec ARRAY<FLOAT>)``; vectors are stored with unit length.
    """
    need = texts.select(F.sha1(text).alias("sha1"), F.col(text).alias("text")).filter("text is not null").dropDuplicates(["sha1"])
    path = f"{cache}/model={model}"
    missing = need.join(spark.read.parquet(path).select("sha1"), "sha1", "left_anti") if _exists(spark, path) else need
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    new = encode(missing).withColumn("_n", norm).select("sha1", F.transform("vec", lambda x: (x / F.greatest(F.col("_n"), F.lit(1e-12))).cast("float")).alias("vec"))
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(need.select("sha1"), "sha1", "left_semi")


def at_path(json: Column, path: str) -> Column:
    """A value of a metrics document by a dotted path; numbers index lists (``a.b.0``)."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(json, "$" + steps)
