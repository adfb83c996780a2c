"""Session helpers: shared checkpoint folder, written stage tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a small side may be broadcast or sent to Python workers in a closure.
BROADCAST_ROWS = 50_000
#: The same for a side of one BIGINT column (a few MB).
BROADCAST_KEYS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is unset (tests, a local session) a temporary folder is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        have = spark.sparkContext.getCheckpointDir()
        named = have or "file://" + tempfile.mkdtemp(prefix="syllaweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage_folder(spark: SparkSession) -> str:
    """The folder of this application's stage tables in the shared folder; it is removed when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/stages-{sc.applicationId}"
    if getattr(sc, "_syllaweave_stages", None) != path:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._syllaweave_stages = path
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove a table made by :func:`written` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(conf).delete(p, True)


def bounded_rows(df: DataFrame, bound: int = BROADCAST_ROWS):
    """Rows of ``df`` if there are at most ``bound`` of them, else None (the caller then takes its distributed way)."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_syllaweave_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="syllaweave-code-"), "syllaweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._syllaweave_shipped = True
