"""A corpus pipeline: toxicity, exact dedup, near dedup, secret redaction, packing.

Each stage works on all that its predecessor kept, and is written as Parquet before the next reads it.
Stages but the last return the columns of documents, extra ones included.  Rows with null texts count as
empty documents; rows that repeat id and text stay or go together; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import exact_dedup, packing, secrets, simhash, toxicity
from matchloom.llm.common import free_name, stored, table, whole_text


def _without(docs: DataFrame, rejected: DataFrame, key) -> DataFrame:
    """The documents whose (doc_id, key of the text) isn't among the rejected (doc_id, key)."""
    id_, key_ = free_name(docs, "__id"), free_name(docs, "__key")
    gone = rejected.select(F.col("doc_id").alias(id_), F.col("key").alias(key_)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (key == F.col(key_)), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the model learns from labelled rows outside the held-out fold."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    found = exact_dedup.exact_dedup(docs)
    return _without(docs, found.where("not kept").select("doc_id", F.col("text_sha256").alias("key")), F.sha2(whole_text("text"), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8), the one with the smallest doc_id."""
    found = simhash.near_dedup(docs)
    return _without(docs, found.where("doc_id <> component_id").select("doc_id", F.col("tkey").alias("key")), F.unhex(F.sha2(whole_text("text"), 256)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark and n_chars counted anew."""
    table_ = secrets.train(secrets.labelled_strings(docs.select(F.col("doc_id").cast("long"), whole_text("text").alias("text"))))
    base, spans = free_name(docs, "__base"), free_name(docs, "__spans")
    found = secrets.with_spans(docs, "text", table_, names=(base, spans))
    text = F.when(F.col("text").isNotNull(), secrets.redact(F.col("text"), F.col(spans)))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids along the curve, with a checksum of each piece."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: SQL has no subsequence kernel, XXH64 or tokenizer; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
