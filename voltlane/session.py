"""Spark session for tests, the bench and local runs.

On a cluster the caller brings its own session; nothing below is required there
except ``spark.sql.session.timeZone=UTC`` and adaptive execution (Spark's default).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Writes a frame under a name and gives it back read from there.
Stage = Callable[[DataFrame, str], DataFrame]


def local_session(cores: str = "8", name: str = "voltlane") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # small test tables: keep all cores busy after adaptive coalescing
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.parquet.enableVectorizedReader", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder for cut lineage, stream checkpoints or staged tables.

    Uses the shared folder the cluster names in ``spark.checkpoint.dir``. Where that is
    unset, a temporary folder serves a session whose executors run in the driver; on a
    cluster, where executors would not see it, an error is raised.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return os.path.join(shared, f"{prefix}-{uuid.uuid4().hex}")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{prefix}-")


def table_stage(spark: SparkSession, folder: str | None = None) -> Stage:
    """Materialise a stage as a parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor re-reads the table instead of recomputing earlier stages.
    """
    root = folder or work_folder(spark, "recompute")

    def stage(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return stage


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession):
    """Shuffles of what is written inside end with it; else their files stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def hadoop_folder(spark: SparkSession, path: str):
    """The file system that ``path`` names, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder, in whatever file system ``path`` names."""
    files, at = hadoop_folder(spark, path)
    files.mkdirs(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job of this library wrote; nothing where there is none."""
    files, at = hadoop_folder(spark, path)
    files.delete(at, True)
