"""Recall ceiling, macro F0.5 and the threshold grid.  Means run over a given list of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocking import PAIR

# Shares of matched entities and singletons in the whole data; thresholds 0.05 to 0.95.
MATCHED_WEIGHT, SINGLETON_WEIGHT = 0.94415, 0.05585
GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def candidate_stats(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """n_pairs, and mean candidates per entity with any and per entity of the list."""
    counts = pairs.agg(F.count("*").alias("n_pairs"), F.count_distinct(PAIR[0]).alias("with_any"))
    return _means(counts, entities)


def _means(counts: DataFrame, entities: DataFrame) -> DataFrame:
    return counts.crossJoin(entities.agg(F.count("*").alias("n"))).select(
        "n_pairs",
        (F.col("n_pairs") / F.greatest("with_any", F.lit(1))).alias("mean_per_covered"),
        (F.col("n_pairs") / F.greatest("n", F.lit(1))).alias("mean_per_entity"),
    )


def chunk_stats(met: DataFrame, entities: DataFrame) -> DataFrame:
    """candidate_stats of chunks that met (operators.met): pairs are counted, not made."""
    of = met.groupBy("chunk_a", F.size("ids_a").cast("long").alias("m")).agg(F.sum(F.size("ids_b").cast("long")).alias("k"))
    counts = of.agg(F.coalesce(F.sum(F.col("m") * F.col("k")), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("m"), F.lit(0)).alias("with_any"))
    return _means(counts, entities)


def recall_ceiling(pairs: DataFrame, truth: DataFrame, countries: DataFrame) -> DataFrame:
    """country ('' with overall true for all), n_true, n_missed, recall of the truth's edges by the pairs."""
    edges = truth.select(F.col("source1_entity_id").alias(PAIR[0]), F.col("entity_id").alias(PAIR[1])).distinct()
    found = edges.join(pairs.select(*PAIR, F.lit(1).alias("hit")).distinct(), PAIR, "left").join(countries, PAIR[0], "left")
    return recall_of(found.select("country", F.lit(1).alias("edges"), F.col("hit").isNotNull().alias("hit")))


def recall_of(found: DataFrame) -> DataFrame:
    """recall_ceiling of true edges in groups: (country, edges: their number, hit)."""
    n, missed = F.coalesce(F.sum("edges"), F.lit(0)), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("edges")))
    grouped = found.groupingSets([["country"], []], "country").agg(F.grouping("country").alias("overall"), n.alias("n_true"), missed.alias("n_missed"))
    return grouped.select(F.coalesce("country", F.lit("")).alias("country"), (F.col("overall") == 1).alias("overall"), "n_true", F.coalesce("n_missed", F.lit(0)).alias("n_missed"), (1 - F.coalesce("n_missed", F.lit(0)) / F.greatest("n_true", F.lit(1))).alias("recall"))


def f05(tp: str, n_pred: str, n_true: str) -> Column:
    """F0.5 of one entity: 1 if nothing is predicted and nothing true, 0 without overlap."""
    p, r = F.col(tp) / F.greatest(n_pred, F.lit(1)), F.col(tp) / F.greatest(n_true, F.lit(1))
    return F.when((F.col(n_pred) == 0) & (F.col(n_true) == 0), F.lit(1.0)).when(F.col(tp) == 0, F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_scores(scored: DataFrame, truth: DataFrame, entities: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """(source1_entity_id, thr, n_true, f05) for every entity of the list and every threshold.

    scored: (pair, prob).  One aggregation gives the counts at all thresholds.
    """
    edges = truth.select(F.col("source1_entity_id").alias(PAIR[0]), F.col("entity_id").alias(PAIR[1]), F.lit(1).alias("is_true")).distinct()
    marked = scored.select(*PAIR, "prob").join(edges, PAIR, "left").select(PAIR[0], "prob", F.col("is_true").isNotNull().alias("hit"), F.lit(1).alias("m"))
    true = edges.groupBy(PAIR[0]).agg(F.count("*").alias("n_true"))
    every = entities.select(PAIR[0]).distinct().join(true, PAIR[0], "left").withColumn("weight", F.lit(1))
    return _group_scores(marked, every, PAIR[0], grid or GRID).drop("weight")


def chunk_scores(met: DataFrame, entities: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """entity_scores by chunk of source 1 (operators.met), with the chunk's number of entities as weight.

    met: (chunk_a, m: a number of pairs of each of its entities, prob, hit); entities: (chunk_a, n_true, weight) of all chunks.  Entities of a chunk have the same
    candidates, scores and truth, so pairs are counted, not made.
    """
    return _group_scores(met, entities, "chunk_a", grid or GRID)


def _group_scores(marked: DataFrame, every: DataFrame, by: str, grid: list[float]) -> DataFrame:
    """(by, thr, n_true, weight, f05).  marked: (by, prob, hit, m: a number of pairs); every: (by, n_true, weight)."""
    at = [(F.sum(F.when(F.col("prob") >= t, F.col("m")).otherwise(0)), F.sum(F.when((F.col("prob") >= t) & F.col("hit"), F.col("m")).otherwise(0))) for t in grid]
    counts = marked.groupBy(by).agg(F.array(*(F.struct(F.lit(t).alias("thr"), n.alias("n_pred"), tp.alias("tp")) for t, (n, tp) in zip(grid, at, strict=True))).alias("cells"))
    none = F.array(*(F.struct(F.lit(t).alias("thr"), F.lit(0).cast("long").alias("n_pred"), F.lit(0).cast("long").alias("tp")) for t in grid))
    found = every.join(counts, by, "left")
    rows = found.select(by, F.coalesce("n_true", F.lit(0)).alias("n_true"), "weight", F.explode(F.coalesce("cells", none)).alias("c")).select(by, "n_true", "weight", "c.thr", "c.n_pred", "c.tp")
    return rows.withColumn("f05", f05("tp", "n_pred", "n_true"))


def threshold_grid(scored: DataFrame, truth: DataFrame, entities: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """(thr, raw_f05, matched_f05, singleton_f05, adjusted_f05) per threshold; an empty stratum scores 0 if matched, 1 if not."""
    return grid_of(entity_scores(scored, truth, entities, grid).withColumn("weight", F.lit(1)))


def _mean(only: Column | None = None) -> Column:
    """The mean of f05 by weight, over the rows of a condition; null without any."""
    w = F.col("weight") if only is None else F.when(only, F.col("weight"))
    return F.sum(w * F.col("f05")) / F.sum(w)


def grid_of(rows: DataFrame) -> DataFrame:
    """threshold_grid of (thr, n_true, f05, weight)."""
    matched = F.coalesce(_mean(F.col("n_true") > 0), F.lit(0.0))
    single = F.coalesce(_mean(F.col("n_true") == 0), F.lit(1.0))
    out = rows.groupBy("thr").agg(_mean().alias("raw_f05"), matched.alias("matched_f05"), single.alias("singleton_f05"))
    return out.withColumn("adjusted_f05", MATCHED_WEIGHT * F.col("matched_f05") + SINGLETON_WEIGHT * F.col("singleton_f05"))


def best_threshold(grid: DataFrame, adjusted: bool = True) -> DataFrame:
    """The row of the best score, the lowest threshold among equals."""
    score = F.col("adjusted_f05" if adjusted else "raw_f05")
    best = F.max_by(F.struct(*grid.columns), F.struct(score.alias("s"), (-F.col("thr")).alias("t")))
    return grid.agg(best.alias("b")).select("b.*")


def macro_f05(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(macro_f05) of predicted pairs over the entities."""
    return entity_scores(predicted.select(*PAIR, F.lit(1.0).alias("prob")), truth, entities, [0.5]).agg(F.avg("f05").alias("macro_f05"))
