"""Tab-separated sources and sinks.  All columns are strings; an empty field is '', never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .quoted import read_quoted

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's own file systems, so any store that Spark reads will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Rows of tab-separated files, with line ends within quotes, read in splits; with ``multi_line`` each file is one task."""
    if not multi_line:
        return read_quoted(spark, path, schema)
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    return rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in schema.names))


def records(raw: DataFrame, *more: str) -> DataFrame:
    """Normalised records of raw ones (entity_id, business_name, business_address, country); columns of ``more`` stay as they are."""
    named = raw.select(
        "entity_id",
        X.country_norm("country").alias("country_norm"),
        X.normalize_name("business_name").alias("norm_name"),
        X.normalize_address("business_address").alias("norm_addr"),
        F.coalesce("business_address", F.lit("")).alias("__raw"),
        *more,
    )
    return named.select(
        "entity_id",
        "country_norm",
        "norm_name",
        "norm_addr",
        X.significant_tokens("norm_name").alias("name_tokens"),
        X.significant_tokens("norm_addr").alias("addr_tokens"),
        X.postal_code("__raw", "country_norm").alias("postal_code"),
        X.numeric_tokens("__raw").alias("num_tokens"),
        X.embed_text("norm_name", "norm_addr").alias("embed_text"),
        *more,
    )


def read_records(spark: SparkSession, path: str, country: str | None = None, multi_line: bool = False) -> DataFrame:
    """Normalised records of a file, of one country if given; the filter runs before normalisation."""
    raw = read_tsv(spark, path, RECORD, multi_line)
    return records(raw if country is None else raw.where(X.country_norm("country") == country))


def read_others(spark: SparkSession, *paths: str, multi_line: bool = False) -> DataFrame:
    """Normalised records of all files that exist; none exist: an empty table."""
    raw = spark.createDataFrame([], RECORD)
    for path in paths:
        if path_exists(spark, path):
            raw = raw.unionByName(read_tsv(spark, path, RECORD, multi_line))
    return records(raw)


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges source1_entity_id, entity_id; all source1_entity_ids).  Of rows with one key the last counts.

    Ids are not trimmed; an empty list is a singleton.
    """
    rows = read_quoted(spark, path, TRUTH, place=True)
    last = rows.groupBy("source1_entity_id").agg(F.max_by("matched_entity_ids", F.struct("file", "start", "at")).alias("ids"))
    edges = last.where("ids <> ''").select("source1_entity_id", F.explode(F.array_distinct(F.split("ids", ","))).alias("entity_id"))
    return edges, last.select("source1_entity_id")


def list_text(ids: str | Column) -> Column:
    """Ids without repeats, in order, joined by commas; null: ''."""
    return F.coalesce(F.array_join(F.array_distinct(F.col(ids) if isinstance(ids, str) else ids), ","), F.lit(""))


def write_tsv(rows: DataFrame, path: str, single: bool = False, order: list[str] | None = None) -> None:
    """Write strings as bare tab-separated fields; ``single`` for small results that must be one file.

    With ``order`` lines follow these columns, over part files by their names; those that start with __ aren't written.
    """
    if order:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        rows = rows.drop(*(c for c in order if c.startswith("__")))
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)
