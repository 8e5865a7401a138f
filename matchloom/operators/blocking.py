"""Blocking: streams of candidate pairs between source 1 and the other sources, and their merge.

Records are those of sources.tsv.records().  Every join has the country among its keys.  Two profiles:
``train_like`` (kNN, rare tokens, exact, sorted and fuzzy names; top 20 at a score of 0.30 or more) and
``predict_like`` (exact and sorted names, rarer tokens with a cap, top 15 by name, then cosine).
Ties go to the smaller candidate id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..sources.store import kept
from . import met
from .skew import balanced_join

# They decide which candidates come out.
TOP_FINAL, TOP_BROAD, TOP_NAME = 20, 50, 15
MIN_SIM, MIN_LEV = 0.30, 0.25
RARE_FRACTION, TOKEN_CAP = 0.02, 200
#: knn_pairs_ivf: the share of the exact neighbours to be found; records and queries that fit the cells; rounds of fitting.
RECALL, CELL_SAMPLE, CELL_QUERIES, CELL_ROUNDS = 0.95, 20_000, 500, 8

#: best_met: rows of a side of a cell, and of the cells that a task takes at a time, about.
SIDE, ROWS = 1024, 8192

PAIR = ["source1_entity_id", "candidate_entity_id"]


def _sides(s1: DataFrame, others: DataFrame, key: Column, **more: Column) -> tuple[DataFrame, DataFrame]:
    a = s1.select(F.col("country_norm").alias("n"), key.alias("key"), F.col("entity_id").alias(PAIR[0]), *(c.alias(f"{k}_a") for k, c in more.items()))
    b = others.select(F.col("country_norm").alias("n"), key.alias("key"), F.col("entity_id").alias(PAIR[1]), *(c.alias(f"{k}_b") for k, c in more.items()))
    return a, b


def _once(pairs: DataFrame, s1: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs that are distinct as they come, unless ids repeat."""
    return pairs if met.unique_ids(s1, others) else pairs.distinct()


def exact_name_pairs(s1: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs with equal normalised names of three characters or more."""
    return _once(met.pairs(met.by_name(kept(met.chunks(s1, [], "a"), "met-a"), kept(met.chunks(others, [], "b"), "met-b"))), s1, others)


def sorted_token_pairs(s1: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs whose significant name tokens are equal as sets."""
    some = F.size("name_tokens") > 0
    a, b = (kept(met.chunks(rows.where(some), [], t), f"met-{t}") for rows, t in ((s1, "a"), (others, "b")))
    return _once(met.pairs(met.by_name(a, b, tokens=True)), s1, others)


def token_frequencies(others: DataFrame) -> DataFrame:
    """(n, token, df, total): document frequency of name tokens and number of records, per country."""
    df = others.select(F.col("country_norm").alias("n"), F.explode("name_tokens").alias("token")).groupBy("n", "token").agg(F.count("*").alias("df"))
    total = others.groupBy(F.col("country_norm").alias("n")).agg(F.count("*").alias("total"))
    return df.join(F.broadcast(total), "n")  # a row per country


def rare_tokens_train(others: DataFrame, fraction: float = RARE_FRACTION) -> DataFrame:
    """Tokens in at most max(int(fraction * N), 3) records."""
    return token_frequencies(others).where(F.col("df") <= F.greatest(F.floor(F.lit(fraction) * F.col("total")).cast("long"), F.lit(3)))


def rare_tokens_predict(others: DataFrame) -> DataFrame:
    """Tokens in at most min(50, max(5, int(N * 0.0005))) records."""
    return token_frequencies(others).where(F.col("df") <= F.least(F.lit(50), F.greatest(F.lit(5), F.floor(F.col("total") * 0.0005).cast("long"))))


def _token_rows(s1: DataFrame, others: DataFrame, rare: DataFrame) -> DataFrame:
    """(pair, token, df) of shared rare tokens; a token's rows on the other side are bounded by its df."""
    a, b = _sides(s1, others, F.explode("name_tokens"))
    rare = rare.select("n", F.col("token").alias("key"), "df")
    return balanced_join(a, b.join(rare, ["n", "key"]), ["n", "key"], *PAIR).select(*PAIR, F.col("key").alias("token"), "df")


def rare_token_pairs(s1: DataFrame, others: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """Pairs that share a rare name token."""
    sides = met.keyed(s1, others, rare if rare is not None else rare_tokens_train(others))
    return _once(met.pairs(met.in_cells(*sides, names=False)), s1, others)


def met_pairs(s1: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs with equal names or a rare name token in common."""
    return _once(met.pairs(met.in_cells(*met.keyed(s1, others, rare_tokens_train(others)))), s1, others)


def fuzzy_name_pairs(s1: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs with a name similarity above 0.9 that share a token or the first three characters, within the length band.

    A join by token and prefix compares all names of a common token, which grows with its square; the index of name segments
    gives the same pairs from names that have a segment in common.
    """
    from .segments import fuzzy_name_pairs as by_segments

    return by_segments(s1, others)


def top_k(pairs: DataFrame, k: int, score: str, by: str = PAIR[0], tie: str = PAIR[1]) -> DataFrame:
    """The k best rows per ``by``, ties to the smaller ``tie``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return pairs.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def knn_pairs(s1: DataFrame, others: DataFrame, k: int = TOP_BROAD, min_sim: float | None = None) -> DataFrame:
    """Exact k nearest by cosine within a country: (pair, sim).  Records carry ``embedding``.

    The work is the product of both sides of a country, as exact search has it; knn_pairs_ivf is for scale.
    """
    a = s1.select(F.col("country_norm").alias("n"), F.col("entity_id").alias(PAIR[0]), F.col("embedding").alias("ea"))
    b = others.select(F.col("country_norm").alias("n"), F.col("entity_id").alias(PAIR[1]), F.col("embedding").alias("eb"))
    near = a.join(b, "n").select(*PAIR, S.dot("ea", "eb").alias("sim"))
    return top_k(near if min_sim is None else near.where(F.col("sim") >= min_sim), k, "sim")


def fit_cells(s1: DataFrame, others: DataFrame, k: int, recall: float = RECALL, sample: int = CELL_SAMPLE, queries: int = CELL_QUERIES, seed: int = 3) -> tuple[np.ndarray, int]:
    """(centres, probes): cells of a spherical k-means over at most about ``sample`` records of the other sources, and
    the least number of cells nearest to a query that hold ``recall`` of the k nearest of about ``queries`` queries.

    Those nearest ones are found exactly, within the sample and the query's country.  They are further away than the k
    nearest of all records, so on the whole table the recall is no less, if the sample is like it.
    """

    def some(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        share = max(1, -(-rows.count() // n))
        kept = rows.where(F.pmod(F.xxhash64("entity_id", F.lit(seed)), F.lit(share)) == 0).select("country_norm", "embedding").limit(2 * n).toPandas()
        vectors = np.stack(kept["embedding"].to_numpy()).astype(np.float32) if len(kept) else np.zeros((0, 1), np.float32)
        return kept["country_norm"].fillna("").to_numpy(), vectors

    (n, x), (m, q) = some(others, sample), some(s1, queries)
    if not len(x):
        return x, 1
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), max(1, int(len(x) ** 0.5)), replace=False)]
    for _ in range(CELL_ROUNDS):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    at = (x @ centres.T).argmax(1)
    ranks = [np.zeros(1, np.int64)]
    for country in np.unique(m):
        of, same = q[m == country], n == country
        sims = of @ x[same].T
        near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-(of @ centres.T), axis=1, kind="stable"), axis=1)
        ranks.append(np.take_along_axis(place, at[same][near], axis=1).ravel())
    return centres, int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1


def knn_pairs_ivf(s1: DataFrame, others: DataFrame, k: int = TOP_BROAD, min_sim: float | None = None, recall: float = RECALL, cells: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """k nearest by cosine within a country, among the records of the cells nearest to each: (pair, sim).

    Every record of the other sources is in one cell, so a pair meets once and no key is shared by all of a country.
    ``cells`` are those of fit_cells, fitted here if not given, for ``recall`` of the pairs that knn_pairs finds.
    """
    centres, probes = cells or fit_cells(s1, others, k, recall)

    def placed(rows: DataFrame, n: int) -> DataFrame:
        @F.pandas_udf("array<int>")
        def nearest(vectors: pd.Series) -> pd.Series:
            if not len(vectors) or not len(centres):
                return pd.Series([[]] * len(vectors), dtype=object)
            scores = np.stack(vectors.to_numpy()).astype(np.float32) @ centres.T
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return rows.withColumn("cell", F.explode(nearest("embedding")))

    from .cells import compared

    of = F.concat("country_norm", F.lit("\n"), F.col("cell").cast("string")).alias("n")  # blocks of a country's cell meet
    a = placed(s1, probes).select(of, F.col("entity_id").alias("qid"), F.col("embedding").alias("q"))
    b = placed(others, 1).select(of, F.col("entity_id").alias("id"), F.col("embedding").alias("v"))
    return compared(a, b, k, min_sim).select(F.col("qid").alias(PAIR[0]), PAIR[1], "sim")


def merge_streams(knn: DataFrame | None, tokens: DataFrame | None, names: DataFrame | None, cosine: DataFrame, k: int = TOP_FINAL, min_sim: float = MIN_SIM) -> DataFrame:
    """(pair, embed_cos): one row per pair of any stream.  ``cosine`` gives (pair, sim) for token and name pairs.

    A kNN score stands; a token pair without one has its cosine; a name pair has 0.88 at least.
    """
    parts = []
    if knn is not None:
        parts.append(knn.select(*PAIR, F.col("sim").alias("ann"), F.lit(False).alias("by_name")))
    if tokens is not None:
        parts.append(tokens.select(*PAIR, F.lit(None).cast("double").alias("ann"), F.lit(False).alias("by_name")))
    if names is not None:
        parts.append(names.select(*PAIR, F.lit(None).cast("double").alias("ann"), F.lit(True).alias("by_name")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merged = both.groupBy(*PAIR).agg(F.max("ann").alias("ann"), F.max("by_name").alias("by_name")).join(cosine, PAIR, "left")
    score = F.when(F.col("by_name"), S.boosted("ann", F.coalesce("sim", F.lit(0.0)))).otherwise(F.coalesce("ann", "sim"))
    return top_k(merged.select(*PAIR, score.alias("embed_cos")).where(F.col("embed_cos") >= min_sim), k, "embed_cos")


def pair_cosine(pairs: DataFrame, s1: DataFrame, others: DataFrame) -> DataFrame:
    """(pair, sim): cosine of the embeddings of given pairs."""
    a = s1.select(F.col("entity_id").alias(PAIR[0]), F.col("embedding").alias("ea"))
    b = others.select(F.col("entity_id").alias(PAIR[1]), F.col("embedding").alias("eb"))
    return pairs.select(*PAIR).join(a, PAIR[0]).join(b, PAIR[1]).select(*PAIR, S.dot("ea", "eb").alias("sim"))


def neighbours(s1: DataFrame, others: DataFrame, knn: str = "auto") -> DataFrame:
    """kNN pairs by a named way: ``auto`` compares all in small countries and searches a tree of cells in large ones."""
    if knn == "auto":
        from .cells import nearest

        return nearest(s1, others)
    return {"exact": knn_pairs, "ivf": knn_pairs_ivf}[knn](s1, others)


def train_like(s1: DataFrame, others: DataFrame, knn: str = "auto") -> DataFrame:
    """(pair, embed_cos) by the training profile; records carry ``embedding``."""
    near = neighbours(s1, others, knn)
    if not met.unique_ids(s1, others):
        return _train_plain(near, s1, others)
    found = near.select(*PAIR, F.col("sim").alias("ann"), F.lit(None).cast("double").alias("sim"), F.lit(False).alias("by_name"))
    both = found.unionByName(best_met(s1, others).withColumn("ann", F.lit(None).cast("double")))
    one = both.groupBy(*PAIR).agg(*(F.max(c).alias(c) for c in ("ann", "sim", "by_name")))
    score = F.when(F.col("by_name"), S.boosted("ann", F.coalesce("sim", F.lit(0.0)))).otherwise(F.coalesce("ann", "sim"))
    return top_k(one.select(*PAIR, score.alias("embed_cos")).where(F.col("embed_cos") >= MIN_SIM), TOP_FINAL, "embed_cos")


def _train_plain(near: DataFrame, s1: DataFrame, others: DataFrame) -> DataFrame:
    """train_like where ids repeat: all pairs are made, compared and merged one by one."""
    names = exact_name_pairs(s1, others).union(sorted_token_pairs(s1, others)).union(fuzzy_name_pairs(s1, others)).distinct()
    tokens = rare_token_pairs(s1, others)
    return merge_streams(near, tokens, names, pair_cosine(tokens.union(names).distinct(), s1, others))


def best_met(s1: DataFrame, others: DataFrame, k: int = TOP_FINAL, min_sim: float = MIN_SIM) -> DataFrame:
    """(pair, sim, by_name): the k best of each record among those with a rare token in common, and among those of equal, equally
    sorted or close names; by the cosine, of names 0.88 at least, ties to the smaller id.

    A pair of a stream that isn't among its k best isn't among the k best of all streams.  Records meet in cells of a key, and a
    cell gives out the k best of each; records of source 1 with equal names and vectors are one, and of such others the k smallest ids do.
    """
    from .cells import QUERY_ROWS, _arrow_matrix, _top_rows, dots_in_order
    from .grid import in_cells
    from .segments import close_names

    fields = [F.col("country_norm").alias("n"), F.col("norm_name").alias("name"), F.col("name_tokens").alias("tokens"), F.col("embedding").alias("v"), F.col("entity_id").alias("id")]
    own, every = kept(s1.select(*fields), "best-source1"), others.select(*fields)
    a = kept(own.groupBy("n", "name", "v").agg(F.first("tokens").alias("tokens"), F.min("id").alias("id")), "best-a")
    rank = F.row_number().over(Window.partitionBy("n", "name", "v").orderBy("id"))
    b = kept(every.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "best-b")
    rare = kept(rare_tokens_train(others).select("n", "token"), "best-rare")
    close = close_names(s1, others).where("name_a <> name_b")
    key = lambda kind, c: F.concat("n", F.lit(f"\n{kind}"), c).alias("key")

    def keys(rows: DataFrame, tag: str) -> DataFrame:
        narrow = rows.select("n", "name", "tokens", "id")
        tokens = narrow.select("n", "id", F.explode("tokens").alias("token")).join(rare, ["n", "token"]).select(key("t", F.col("token")), "id")
        same = narrow.select("n", F.col("name").alias("name_x"), F.col("tokens").alias("tokens_x"), "id").select(key("s", met.same_key("x", tokens=True)), "id")
        named = narrow.withColumnRenamed("name", f"name_{tag}")
        fuzzy = named.join(close, ["n", "name_a"]) if tag == "a" else named.join(close, ["n", "name_b"], "left_semi")
        return kept(tokens.unionByName(same).unionByName(fuzzy.select(key("f", F.col("name_b")), "id")).where("key is not null").withColumn("by_name", F.substring_index("key", "\n", -1).substr(1, 1) != "t"), f"best-keys-{tag}")

    schema = pa.schema([("qid", pa.string()), (PAIR[1], pa.string()), ("sim", pa.float64()), ("by_name", pa.bool_())])

    def nearest(x: pa.Table, y: pa.Table) -> pa.Table:
        y, by_name = y.sort_by("id"), x["by_name"][0].as_py()
        v, ids, out = _arrow_matrix(y["v"]), y["id"].to_numpy(), []
        for at in range(0, len(x), QUERY_ROWS):
            part = x.slice(at, QUERY_ROWS)
            sims = dots_in_order(_arrow_matrix(part["q"]), v)
            row, col = _top_rows(np.maximum(sims, 0.88) if by_name else sims, k)
            good = by_name | (sims[row, col] >= min_sim)
            row, col = row[good], col[good]
            out.append(pa.table([part["qid"].to_numpy()[row], ids[col], sims[row, col], np.full(len(row), by_name)], schema=schema))
        return pa.concat_tables(out)

    left, right = keys(a, "a").withColumnRenamed("id", "qid"), keys(b, "b").drop("by_name")
    wide = a.select(F.col("id").alias("qid"), F.col("v").alias("q")), b.select("id", "v")
    found = in_cells(left, right, "key", "qid", "id", nearest, f"qid string, {PAIR[1]} string, sim double, by_name boolean", SIDE, ROWS, wide)
    # A pair of several cells has equal rows in each stream; the k best are told over those that differ.
    score = F.when(F.col("by_name"), F.greatest("sim", F.lit(0.88))).otherwise(F.col("sim"))
    rank = F.dense_rank().over(Window.partitionBy("qid", "by_name").orderBy(F.desc("score"), PAIR[1]))
    best = found.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k).groupBy("qid", PAIR[1]).agg(F.max("sim").alias("sim"), F.max("by_name").alias("by_name"))
    of = a.select("n", "name", "v", F.col("id").alias("qid"))
    members = own.select("n", "name", "v", F.col("id").alias(PAIR[0])).join(of, ["n", "name", "v"]).select("qid", PAIR[0])
    return members.join(best, "qid").select(*PAIR, "sim", "by_name")


def _met_capped(s1: DataFrame, others: DataFrame, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks of source 1, those of the others, chunks that meet within the cap by a rare token and not by name).

    A token's rank is its place among a chunk's keys, and chunks meet at the first that they share, so no pair of records is
    needed to tell the rank of a pair, and a window over a chunk's candidates has few rows: names and tokens past the cap are counts.
    """
    a, b = met.keyed(s1, others, rare_tokens_predict(others))
    named = lambda rows, tag: rows.withColumn(f"same_{tag}", met.same_key(tag, tokens=True))
    a, b = named(a, "a"), named(b, "b")
    exact = b.where("same_b is not null").groupBy("n", F.col("same_b").alias("same_a")).agg(F.sum(F.size("ids_b").cast("long")).alias("exact"))
    tokens = met.by_token(a.drop("ids_a"), b).where("same_a <> same_b").withColumn("rank", F.array_position("keys_a", F.col("key")))
    lower = F.sum(F.size("ids_b")).over(Window.partitionBy("chunk_a").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1))
    counted = tokens.select("n", "same_a", "chunk_a", "name_a", "name_b", "ids_b", F.coalesce(lower, F.lit(0)).alias("before")).join(exact, ["n", "same_a"], "left")
    return a, b, counted.where(F.col("before") + F.coalesce("exact", F.lit(0)) <= cap).select("chunk_a", "name_a", "name_b", "ids_b")


def capped_candidates(s1: DataFrame, others: DataFrame, cap: int = TOKEN_CAP) -> DataFrame:
    """(pair, exact): exact and sorted-name pairs, then rare tokens in order of (df, token) until a record
    has more than ``cap`` candidates; the token that passes the cap still counts."""
    if not met.unique_ids(s1, others):
        return _capped_plain(s1, others, cap)
    a, b, tokens = _met_capped(s1, others, cap)
    names = met.pairs(met.by_name(a, b, tokens=True), F.lit(True).alias("exact"))
    return names.unionByName(met.pairs(tokens.join(a.select("chunk_a", "ids_a"), "chunk_a"), F.lit(False).alias("exact")))


def _capped_plain(s1: DataFrame, others: DataFrame, cap: int) -> DataFrame:
    """capped_candidates where ids repeat: pairs are made, grouped and ranked one by one."""
    exact = exact_name_pairs(s1, others).union(sorted_token_pairs(s1, others)).distinct().select(*PAIR, F.lit(0).alias("rank"))
    rows = _token_rows(s1, others, rare_tokens_predict(others))
    tokens = rows.select(*PAIR, F.dense_rank().over(Window.partitionBy(PAIR[0]).orderBy("df", "token")).alias("rank"))
    first = exact.unionByName(tokens).groupBy(*PAIR).agg(F.min("rank").alias("rank"))
    sizes = first.groupBy(PAIR[0], "rank").agg(F.count("*").alias("new"))
    before = F.coalesce(F.sum("new").over(Window.partitionBy(PAIR[0]).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sizes.withColumn("before", before).where(F.col("before") <= cap).select(PAIR[0], "rank")
    return first.join(open_, [PAIR[0], "rank"]).select(*PAIR, (F.col("rank") == 0).alias("exact"))


def name_top(candidates: DataFrame, s1: DataFrame, others: DataFrame, k: int = TOP_NAME, least: float = MIN_LEV) -> DataFrame:
    """(pair, name_sim): the k best by name similarity; exact pairs count as 1, others need ``least``."""
    a = s1.select(F.col("entity_id").alias(PAIR[0]), F.col("norm_name").alias("na"))
    b = others.select(F.col("entity_id").alias(PAIR[1]), F.col("norm_name").alias("nb"))
    sim = F.when(F.col("exact"), F.lit(1.0)).otherwise(S.lev_ratio("na", "nb"))
    scored = candidates.join(a, PAIR[0]).join(b, PAIR[1]).select(*PAIR, "exact", sim.alias("name_sim"))
    return top_k(scored.where(F.col("exact") | (F.col("name_sim") >= least)), k, "name_sim").select(*PAIR, "name_sim")


def capped_top(s1: DataFrame, others: DataFrame, k: int = TOP_NAME, least: float = MIN_LEV, cap: int = TOKEN_CAP) -> DataFrame:
    """name_top of capped_candidates.  Of records with equal names or tokens the k smallest ids are enough, as all count as 1,
    and a chunk's candidates are ranked once, so neither the pairs of large groups nor those of copies are made."""
    if not met.unique_ids(s1, others):
        return name_top(capped_candidates(s1, others, cap), s1, others, k, least)
    a, b, tokens = _met_capped(s1, others, cap)
    of = ["n", "same_b"]
    low = b.where("same_b is not null").select(*of, F.explode("ids_b").alias(PAIR[1]))
    low = low.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(PAIR[1]))).where(F.col("rank") <= k)
    low = low.groupBy("n", F.col("same_b").alias("same_a")).agg(F.collect_list(PAIR[1]).alias("ids_b"))
    exact = a.join(low, ["n", "same_a"]).select("chunk_a", "ids_b", F.lit(1.0).alias("name_sim"))
    alike = tokens.select("chunk_a", "ids_b", S.lev_ratio("name_a", "name_b").alias("name_sim")).where(F.col("name_sim") >= least)
    best = top_k(exact.unionByName(alike).select("chunk_a", "name_sim", F.explode("ids_b").alias(PAIR[1])), k, "name_sim", by="chunk_a")
    return best.join(a.select("chunk_a", "ids_a"), "chunk_a").select(F.explode("ids_a").alias(PAIR[0]), PAIR[1], "name_sim")


def predict_like(s1: DataFrame, others: DataFrame) -> DataFrame:
    """(pair, embed_cos) by the prediction profile; embeddings are compared for the name-filtered pairs alone."""
    chosen = capped_top(s1, others)
    cosine = pair_cosine(chosen, s1, others).where(F.col("sim") >= MIN_SIM)
    return top_k(cosine.select(*PAIR, F.col("sim").alias("embed_cos")), TOP_FINAL, "embed_cos")
