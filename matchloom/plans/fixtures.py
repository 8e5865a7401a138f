"""Record-linkage inputs as views of the data folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import blocking, met
from ..operators.blocking import PAIR
from ..sources import tsv
from ..sources.store import kept

ENTITY = """
    doc_id,
    concat('S', CAST(1 + doc_id % 3 AS STRING), '-', CAST(doc_id AS STRING)) AS entity_id,
    1 + doc_id % 3 AS src,
    CASE lang WHEN 'en' THEN 'us' WHEN 'fr' THEN 'france' WHEN 'de' THEN 'india' ELSE lang END AS country,
    replace(substring(text, 1, 60), chr(10), ' ') AS business_name,
    concat(replace(substring(text, 61, 120), chr(10), ' '), ' ',
           CAST(CASE WHEN lang = 'de' THEN 100000 + n_chars ELSE n_chars END AS STRING)) AS business_address,
    substring(text, 1, 20) AS head
"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entities from documents, with src and head."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*_split(ENTITY))


def _split(select: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[start:i])
            start = i + 1
    return [*out, select[start:]]


#: What the streams of names read of a record.
NAMES = ["entity_id", "country_norm", "norm_name", "name_tokens"]


#: Country and first 20 characters as they are: true edges are between records with the same, null matches nothing.
GOLD = "gold_key"


def sides(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(source 1, others) as normalised records, or some of their columns, normalised once and kept for all streams of a query."""
    raw = entities(spark, sf_dir)
    more = [c for c in columns if c == GOLD]
    raw = raw.withColumn(GOLD, F.concat("country", F.lit("\n"), "head")) if more else raw
    cores = spark.sparkContext.defaultParallelism
    if raw.rdd.getNumPartitions() < cores:  # few splits: normalising is work for all cores
        raw = raw.repartition(cores)
    rows = tsv.records(raw, *more)
    rows = kept(rows.select(*columns) if columns else rows, "records")
    return rows.where("entity_id like 'S1-%'"), rows.where("entity_id not like 'S1-%'")


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sides(spark, sf_dir, *NAMES)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True edges (source1_entity_id, entity_id): same country and same first 20 characters."""
    raw = entities(spark, sf_dir).select("entity_id", "src", "country", "head")
    a = raw.where("src = 1").select(F.col("entity_id").alias("source1_entity_id"), "country", "head")
    b = raw.where("src > 1").select("entity_id", "country", "head")
    return a.join(b, ["country", "head"]).select("source1_entity_id", "entity_id")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(source 1, others) from embeddings; the label is the country."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id"), F.col("vec_id").cast("string").alias("entity_id"), F.col("label").cast("string").alias("country_norm"), "embedding")
    return rows.where("vec_id % 3 = 0"), rows.where("vec_id % 3 <> 0")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, prob): exact and rare-token pairs with their name Jaccard as probability, made where their records meet."""
    s1, others = names(spark, sf_dir)
    if met.unique_ids(s1, others):
        return met.pairs(met_chunks(s1, others), "prob")
    pairs = blocking.met_pairs(s1, others)
    a = s1.select(F.col("entity_id").alias(PAIR[0]), F.col("name_tokens").alias("ta"))
    b = others.select(F.col("entity_id").alias(PAIR[1]), F.col("name_tokens").alias("tb"))
    return pairs.join(a, PAIR[0]).join(b, PAIR[1]).select(*PAIR, F.round(S.jaccard("ta", "tb"), 6).alias("prob"))


def met_chunks(s1: DataFrame, others: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    """The chunks of operators.met behind scored(), with prob."""
    sides = met.keyed(s1, others, blocking.rare_tokens_train(others), more)
    return met.by_either(*sides).withColumn("prob", F.round(met.jaccard(), 6))


POSTAL_CASES = [(1, "x 012345 y", "india"), (2, "a 560001", "india"), (3, "12345-6789", "us"), (4, "F-75008 Paris", "france"), (5, "no 1234567", "us"), (6, "ab 1234 cd 123456", "es"), (7, "", "us"), (8, "_12345 54321_ 98765", "us")]


def postal_cases(spark: SparkSession) -> DataFrame:
    """Literal addresses for the postal rules."""
    return spark.createDataFrame(POSTAL_CASES, "case_id int, address string, country string").withColumn("code", X.postal_code("address", "country"))


#: Documents as lines of a match list, by their id and size: good rows, rows without a tab, empty lines and lists, rows of
#: entities that aren't asked for, keys of the row before, ids that repeat, belong to source 1, have a space or a wrong prefix.
_KEY = "concat('S1-', CAST(doc_id - CASE WHEN n % 11 = 0 THEN 3 ELSE 0 END AS STRING))"
_ID = "concat('S', CAST(1 + (doc_id + n) % 3 AS STRING), '-', CAST(n AS STRING))"
_MORE = f"""CASE n % 4 WHEN 0 THEN concat(',', {_ID}) WHEN 1 THEN concat(', S3-', CAST(doc_id AS STRING))
    WHEN 2 THEN CASE WHEN n % 9 = 0 THEN concat(',X-', CAST(n AS STRING)) ELSE '' END ELSE concat(',S2-', CAST(n + 1 AS STRING)) END"""
_SIZES = "(SELECT doc_id, coalesce(n_chars, 0) AS n FROM {documents}) t WHERE doc_id % 3 = 0 OR n % 13 = 0"
MATCH_LINES = f"""SELECT doc_id + 2 AS line_no, CASE WHEN n % 17 = 0 THEN concat({_KEY}, ' without a tab') WHEN n % 19 = 0 THEN ''
    WHEN n % 5 = 0 THEN concat({_KEY}, chr(9)) ELSE concat({_KEY}, chr(9), {_ID}, {_MORE}) END AS value FROM {_SIZES}"""
#: The same rows as candidates, with every second id left out of some.
CANDIDATE_LINES = f"SELECT doc_id + 2 AS line_no, concat({_KEY}, chr(9), {_ID}, CASE WHEN n % 7 = 0 THEN '' ELSE {_MORE} END) AS value FROM {_SIZES}"
REQUIRED = "SELECT concat('S1-', CAST(doc_id AS STRING)) AS s1 FROM {documents} WHERE doc_id % 3 = 0"
TARGETS = "SELECT concat('S', CAST(1 + doc_id % 3 AS STRING), '-', CAST(doc_id AS STRING)) AS id FROM {documents} WHERE doc_id % 3 > 0"


def of_documents(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the selections above over a data folder."""
    return spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
