"""Stored tables whose files are far smaller than their rows stay off the driver."""

from pyspark.sql import functions as F

from matchloom.operators import features, segments, tfidf
from matchloom.plans import fixtures as fx
from matchloom.sources import store


def broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_are_not_broadcast(spark):
    rows = store.kept(spark.range(100_000).select("id", F.lit("a long name " * 20).alias("name"), F.sequence(F.lit(1), F.lit(50)).alias("list")), "test-rows")
    assert not broadcasts(spark.range(1_000_000).join(rows, "id"))
    assert not broadcasts(spark.range(1_000_000).join(rows.where("id > 3").groupBy("id").agg(F.max("name")), "id"))
    assert broadcasts(spark.range(1_000_000).join(store.kept(spark.range(10), "test-few"), "id"))


def test_names_and_idf_are_not_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(store, "SMALL", 0)
    s1, others = fx.sides(spark, sf)
    assert not broadcasts(segments.name_pairs(segments._names(s1, "a"), segments._names(others, "b")))
    for idf, column in zip(features.fit_idf(s1, others), ("norm_name", "norm_addr"), strict=True):
        assert not broadcasts(tfidf.weigh(s1, idf, "entity_id", column))
