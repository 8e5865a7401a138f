"""Shared folder, stored intermediates and small helpers for the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []
_HOLDER: list = []


def claim(owner: str, clear) -> None:
    """One operator's cache at a time in a Python worker: another owner's is cleared first."""
    if _HOLDER and _HOLDER[0] != owner:
        _HOLDER[1]()
    _HOLDER[:] = [owner, clear]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets one of its own; a cluster session is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/matchloom-shared-{os.getuid()}"
    at = spark._jvm.org.apache.hadoop.fs.Path(base)  # with its scheme, so that Python and Spark mean the same store
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one; it is removed when the driver's Python ends."""
    path = f"{shared_base(spark)}/matchloom/{tag}-{uuid.uuid4().hex[:12]}"
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append(path)
    return path


def _sweep() -> None:
    for path in _WRITTEN:
        try:
            drop_dir(path)
        except OSError:
            continue  # already gone, or the store is unreachable at exit


def drop_dir(uri: str) -> None:
    files, path = filesystem(uri)
    files.delete_dir(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a stored table, and nothing else, before the driver ends; no plan may read it any more."""
    drop_dir(df.stored_at)
    _WRITTEN.remove(df.stored_at)


def a_task_each(files: DataFrame, key: str = "part") -> DataFrame:
    """The rows of a manifest dealt by range of its key, so that a task has about one of them; none is gathered."""
    return files.repartitionByRange(max(1, files.count()), key)


def whole_text(text: str | Column) -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string without nulls); all other columns, whatever their names, are left."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))


def slices(batches, rows: int = 256, volume: int = 8 << 20):
    """Arrow batches cut to at most ``rows`` rows and about ``volume`` bytes, one row at least."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > volume:
                n = max(1, n // 2)
            yield batch.slice(at, n)
            at += n


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Published:
    """A file written beside its name and renamed when complete, so that a lost task leaves no half file."""

    def __init__(self, uri: str):
        self.files, self.path = filesystem(uri)
        self.partial = f"{self.path}.{uuid.uuid4().hex[:8]}.partial"
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.partial, compression=None)
        self.size = 0

    def write(self, data) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def publish(self) -> None:
        self.out.close()
        self.files.move(self.partial, self.path)

    def discard(self) -> None:
        self.out.close()
        self.files.delete_file(self.partial)
