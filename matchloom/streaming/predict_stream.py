"""Stateless prediction over a stream of source-1 files against a snapshot of the other sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import embedding
from ..plans import linkage
from ..sources import tsv


def predict_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, linker: linkage.Linker, others: DataFrame, profile: str = "train_like", knn: str = "auto", once: bool = True, load=None) -> StreamingQuery:
    """Append candidate and match lists as Parquet, one folder per batch, so a batch that runs again replaces its own.
    ``load``: the embedder of ``others`` and of training, by default the hashed one."""
    raw = spark.readStream.schema(tsv.RECORD).option("sep", "\t").option("header", True).option("escape", '"').csv(in_dir)
    raw = raw.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in tsv.RECORD.names))

    def batch(rows: DataFrame, number: int) -> None:
        s1 = embedding.embed(tsv.records(rows), load=load).cache()
        candidates, matches = linkage.predict(linker, s1, others, profile, knn)
        candidates.write.mode("overwrite").parquet(f"{out_dir}/candidates/batch={number}")
        matches.write.mode("overwrite").parquet(f"{out_dir}/matches/batch={number}")
        s1.unpersist()

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
