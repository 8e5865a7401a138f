"""Tables kept in the folder that the driver and all executors share, for plans that read them more than once."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files whose rows may be broadcast: by Spark's estimate, which takes files for rows, 10 MB would be.
SMALL = 1 << 16

_WRITTEN: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it (tests) gets a folder of its own, a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/matchloom-store-{os.getuid()}"
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own below the shared folder; what is there is removed when the driver ends."""
    path = f"{shared_folder(spark)}/matchloom-store/{tag}-{uuid.uuid4().hex[:12]}"
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    return path


def kept(df: DataFrame, tag: str) -> DataFrame:
    """The table, written as Parquet below the shared folder and read back.

    Its lineage ends there, so a lost executor costs what it was working on and nothing before.  Rows that repeat, and arrays, have files
    far smaller than what the driver would hold of them, so joins don't broadcast what is larger than ``SMALL``.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return rows if size <= SMALL else rows.hint("merge")


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone before
            return
