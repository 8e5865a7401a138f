"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) for each vertex u of the links (a, b) that isn't its component's smallest; v is that smallest.

    Each round hangs a vertex's larger neighbours below its smallest neighbour (large star), then its
    smaller ones (small star); the number of links never grows, and rounds grow with the logarithm of
    the component size, so 60 are enough for any table; beyond them an error is raised.  Links stay
    distributed; only a count and a hash sum reach the driver.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(links)
    for _ in range(rounds):
        if not state[0]:
            return links
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, links = links, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(old)
        before, state = state, _state(links)
        if state == before:
            return links
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
