"""Booklets that arrive while the engine runs: the parser as a file stream, with each course record once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from syllaweave.operators.parse import keep_recent, parse_pages
from syllaweave.sources.files import PAGES


def page_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """New page files of a folder as they arrive."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).json(folder)


def parsed_stream(pages: DataFrame) -> DataFrame:
    """Course records of a page stream with the whole hash of their content; the id shows its first eight digits."""
    content = F.md5(F.to_json(F.struct("course_key", "code", "academic_year", "program", "semester", F.col("units.text").alias("units"), "objectives")))
    r = keep_recent(parse_pages(pages)).withColumn("content", content)
    return r.withColumn("id", F.concat(F.lit("nm"), F.substring("content", 1, 8)))


def run(pages: DataFrame, sink: str, checkpoint: str):  # noqa: ANN201
    """Write each new record once: records are told apart by their whole content hash.

    Two different records whose short ids collide both stay: the later one shows its whole hash. The sink is partitioned
    by the first two digits of the hash, so a micro-batch reads only the hashes of the partitions that it may repeat.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["content"]).withColumn("part", F.substring("content", 1, 2))
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            parts = [r[0] for r in new.select("part").distinct().collect()]  # 256 at most
            have = spark.read.schema("content string, id string, part string").parquet(sink).filter(F.col("part").isin(parts))
            new = new.join(have.select("content"), "content", "left_anti")
            new = new.join(have.select("id").distinct().withColumn("taken", F.lit(True)), "id", "left")
        else:
            new = new.withColumn("taken", F.lit(False))
        first = F.row_number().over(Window.partitionBy("id").orderBy("content")) == 1
        new = new.withColumn("first", first).withColumn("id", F.when(F.col("first") & ~F.coalesce("taken", F.lit(False)), F.col("id")).otherwise(F.concat(F.lit("nm"), "content")))
        new.drop("taken", "first").write.mode("append").partitionBy("part").parquet(sink)

    return parsed_stream(pages).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
