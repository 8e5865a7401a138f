"""The best candidates by shared rare tokens, without all pairs that share one: a block-max inverted index.

Wanted: for each record of source 1 the ``k`` best records of the other sources, of its country, that share a rare name
token with it, by the Jaccard similarity of name tokens, ties to the smaller id.  As a rare token may stand in a
share of all records, the pairs that share one grow with the square of the table.  Here:

1.  Records with equal country and tokens are one class on either side; of a class's ids the k smallest are enough.
2.  A rare token's list has the classes with it.  Queries go to the lists of their rare tokens, and come back with their
    k best of each: lists and queries meet in cells (operators.grid), so neither blocks nor bounds are shuffled or stored.
3.  In a cell, a list is dealt into blocks of ``BLOCK`` classes of one size, alike in their commonest tokens.  A block knows the
    size, its smallest id, and which of the cell's tokens it has; with the query's tokens these bound the score of its classes.
4.  A class that shares the list's token alone scores by its number of tokens, so of those the k with the fewest tokens, then
    the smallest ids, are looked at.  A query opens the blocks of the highest bounds that together hold twice k classes; the k-th
    best is the score to beat.  Of the other blocks it opens those whose bound is above it, or equal with a smaller id.

The result is exact, and a query opens few blocks beside those that hold its result.  What is shuffled is a row per
class and rare token, a query's k best per list, and a copy more per ``SIDE`` rows that a list has on the other side.

Records with null or empty tokens have no candidates; records that repeat an id count once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import kept
from . import met
from .blocking import PAIR, TOP_FINAL, rare_tokens_train
from .grid import in_cells

#: Classes of a block.
BLOCK = 8
#: Rows of a side of a cell, and of the cells that a task takes at a time, about.
SIDE, ROWS = 4096, 8192

FOUND = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("first", pa.string()), ("score", pa.float64())])


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(n, tokens, first, ids): a row per country and set of tokens, with its k smallest ids."""
    own = rows.where(F.size("name_tokens") > 0).select(F.col("country_norm").alias("n"), F.col("name_tokens").alias("tokens"), F.col("entity_id").alias("id")).distinct()
    rank = F.row_number().over(Window.partitionBy("n", "tokens").orderBy("id"))
    low = own.withColumn("rank", rank).where(F.col("rank") <= k)
    return low.groupBy("n", "tokens").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("n", "tokens", F.col("ids")[0].alias("first"), "ids")


def _coded(classes: DataFrame, tokens: DataFrame, by: str) -> DataFrame:
    """(by, codes, rare): the numbers of a class's tokens, the commonest first, and of its rare ones; classes without are left out."""
    each = classes.select(by, "n", F.explode("tokens").alias("token")).join(tokens, ["n", "token"])
    ordered = each.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("df", "t", "rare")), asc=False).alias("o"))
    return ordered.select(by, F.col("o.t").alias("codes"), F.filter("o", lambda t: t["rare"])["t"].alias("rare")).where(F.size("rare") > 0)


def _best(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k best (score, place), the best first; rows that are equal in both count once and all come."""
    order = np.lexsort((place, -score))
    s, p = score[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1])
    return order[np.cumsum(new) <= k]


class _List:
    """The blocks of a list's classes in a cell: ``codes`` in a row each, padded by -1, ``place`` the order of their first ids."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, place: np.ndarray, tokens: int, k: int, block: int):
        self.k, self.block = k, block
        self.order = order = np.lexsort((*codes.T[::-1], sizes))
        self.codes, self.sizes, self.place = codes[order], sizes[order], place[order]
        since = np.searchsorted(self.sizes, self.sizes)  # the first class of the size
        starts = np.flatnonzero((np.arange(len(order)) - since) % block == 0)
        self.of = np.searchsorted(starts, np.arange(len(order)), "right") - 1
        self.block_sizes, self.low = self.sizes[starts], np.minimum.reduceat(self.place, starts)
        row, col = np.nonzero(self.codes >= 0)
        has = np.unique(self.codes[row, col].astype(np.int64) * len(starts) + self.of[row])
        self.blocks, self.offsets = has % len(starts), np.searchsorted(has // len(starts), np.arange(tokens + 1))
        self.heads = _best(-self.sizes, self.place, k)
        self.mark = np.zeros(tokens + 1, bool)  # the last is the padding's

    def _scores(self, rows: np.ndarray, size: int) -> np.ndarray:
        shared = self.mark[self.codes[rows]].sum(1)
        return shared / (size + self.sizes[rows] - shared)

    def looked_at(self, tokens: np.ndarray, size: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the classes that are compared with a query of ``size`` tokens, of which the cell knows ``tokens``;
        without ``every``, of those that may be among the k best."""
        self.mark[tokens] = True
        rows, more = np.arange(len(self.place)), None
        if len(rows) > 2 * self.k:
            own = np.concatenate([self.blocks[self.offsets[t] : self.offsets[t + 1]] for t in tokens])
            most = np.minimum(np.bincount(own, minlength=len(self.low)), self.block_sizes)
            bound, may = most / (size + self.block_sizes - most), most > 1
            best, opens = np.flatnonzero(may), -(-2 * self.k // self.block)
            if len(best) > opens:  # of equal bounds the smaller ids, as far as doubles tell
                best = best[np.argpartition(self.low[best] * 1e-9 - bound[best], opens)[:opens]]
            opened = np.zeros(len(self.low), bool)
            opened[best] = True
            first = opened[self.of]
            first[self.heads] = True
            rows = np.flatnonzero(first)
            scores = self._scores(rows, size)
            last = _best(scores, self.place[rows], self.k)[-1]  # the heads alone are k, or all places
            beat, at = scores[last], self.place[rows[last]]
            more = np.flatnonzero((may & ~opened & ((bound > beat) | ((bound == beat) & (self.low < at))))[self.of] & ~first)
        else:
            scores = self._scores(rows, size)
        if more is not None and len(more):
            score = self._scores(more, size)
            good = every | (score > beat) | ((score == beat) & (self.place[more] < at))
            rows, scores = np.concatenate([rows, more[good]]), np.concatenate([scores, score[good]])
        self.mark[tokens] = False
        return rows, scores


def _searched(k: int, block: int, every: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a cell gives out: each query's k best classes or, for ``every``, all that were compared with it."""

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("first")
        first, ids = y["first"].combine_chunks(), y["c"].to_numpy()
        place = np.zeros(len(y), np.int64)
        place[1:] = np.cumsum(pc.not_equal(first[1:], first[:-1]).to_numpy(zero_copy_only=False))
        sizes = pc.list_value_length(y["codes"]).to_numpy().astype(np.int64)
        known, codes = np.unique(pc.list_flatten(y["codes"]).to_numpy(), return_inverse=True)
        padded = np.full((len(y), sizes.max()), -1, np.int32)
        padded[np.arange(sizes.max()) < sizes[:, None]] = codes
        of = _List(padded, sizes, place, len(known), k, block)
        asked = pc.list_flatten(x["codes"]).to_numpy()
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        hits = known[at] == asked
        ends = np.cumsum(pc.list_value_length(x["codes"]).to_numpy())
        rows, scores = [], []
        for start, end, size in zip([0, *ends[:-1]], ends, x["size"].to_numpy()):
            found, score = of.looked_at(at[start:end][hits[start:end]], size, every)
            best = slice(None) if every else _best(score, of.place[found], k)
            rows.append(of.order[found[best]])
            scores.append(score[best])
        row = np.concatenate(rows)
        q = np.repeat(x["q"].to_numpy(), [len(r) for r in rows])
        return pa.table([q, ids[row], first.take(pa.array(row)), np.concatenate(scores)], schema=FOUND)

    return cell


class TokenIndex:
    """The other sources' classes by rare token: stored tables, for any number of searches."""

    def __init__(self, others: DataFrame, k: int = TOP_FINAL, block: int = BLOCK, rare: DataFrame | None = None):
        self.k, self.block = k, block
        self.classes = kept(_classes(others, k).withColumn("c", F.monotonically_increasing_id()), "blockmax-classes")
        rare = (rare if rare is not None else rare_tokens_train(others)).select("n", "token", F.lit(True).alias("rare"))
        counts = self.classes.select("n", F.explode("tokens").alias("token")).groupBy("n", "token").agg(F.count("*").alias("df"))
        known = counts.join(rare, ["n", "token"], "left").select("n", "token", "df", F.coalesce("rare", F.lit(False)).alias("rare"), F.monotonically_increasing_id().alias("t"))
        self.tokens = kept(known, "blockmax-tokens")
        self.coded = kept(_coded(self.classes, self.tokens, "c").join(self.classes.select("c", "first"), "c"), "blockmax-coded")

    def _queries(self, s1: DataFrame) -> DataFrame:
        """(n, tokens, q, size): the classes of queries, stored."""
        queries = s1.where(F.size("name_tokens") > 0).select(F.col("country_norm").alias("n"), F.col("name_tokens").alias("tokens")).distinct()
        return kept(queries.withColumn("q", F.monotonically_increasing_id()).withColumn("size", F.size("tokens")), "blockmax-queries")

    def _met(self, queries: DataFrame, every: bool = False) -> DataFrame:
        """(q, c, first, score) as the cells give them out; a class may come from several lists of a query."""
        asked = kept(_coded(queries, self.tokens, "q").join(queries.select("q", "size"), "q"), "blockmax-asked")
        left, right = (x.select(F.explode("rare").alias("key"), by) for x, by in ((asked, "q"), (self.coded, "c")))
        wide = asked.select("q", "codes", "size"), self.coded.select("c", "codes", "first")
        return in_cells(left, right, "key", "q", "c", _searched(self.k, self.block, every), "q long, c long, first string, score double", SIDE, ROWS, wide)

    def looked_at(self, s1: DataFrame) -> DataFrame:
        """(q, c, first, score): the classes c that are compared with each class of queries q, once a list."""
        return self._met(self._queries(s1), every=True)

    def search(self, s1: DataFrame) -> DataFrame:
        """(pair, score): the k best candidates of each record of source 1."""
        queries = self._queries(s1)
        # The k best classes hold the k best ids.  Equal rows of several lists, and of an id of several classes, count once.
        best = lambda rows, tie: rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), tie))).where(F.col("rank") <= self.k)
        classes = kept(best(self._met(queries), "first").select("q", "c", "score").distinct(), "blockmax-first")
        each = classes.join(self.classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias(PAIR[1]))
        found = best(each, PAIR[1]).select("q", PAIR[1], "score").distinct()
        own = s1.select(F.col("country_norm").alias("n"), F.col("name_tokens").alias("tokens"), F.col("entity_id").alias(PAIR[0])).distinct()
        return own.join(queries, ["n", "tokens"]).select("q", PAIR[0]).join(found, "q").select(*PAIR, "score")


def rare_token_topk(s1: DataFrame, others: DataFrame, k: int = TOP_FINAL) -> DataFrame:
    """(pair, score): of the pairs that share a rare name token, each record's k best by Jaccard similarity, then id."""
    return TokenIndex(others, k).search(s1)


def met_topk(s1: DataFrame, others: DataFrame, k: int = TOP_FINAL, tokens: bool = False) -> DataFrame:
    """(pair, score): rare_token_topk for records with a rare token; others have the k smallest ids of equal names or, with
    ``tokens``, of equal tokens, at a score of 1.  Names that are equal have equal tokens, so with a rare token they meet by it."""
    rare = kept(rare_tokens_train(others).select("n", "token", "df"), "blockmax-rare")
    with_rare = lambda rows: rows.select(F.col("country_norm").alias("n"), "name_tokens").distinct().select("n", "name_tokens", F.explode("name_tokens").alias("token")).join(rare, ["n", "token"]).select(F.col("n").alias("country_norm"), "name_tokens").distinct()
    named = [F.col("country_norm").alias("n"), F.col("norm_name").alias("name_x"), F.col("name_tokens").alias("tokens_x"), F.col("entity_id").alias("id")]
    keyed = lambda rows: rows.join(with_rare(rows), ["country_norm", "name_tokens"], "left_anti").select(*named).select("n", met.same_key("x", tokens).alias("key"), "id").where("key is not null")
    low = keyed(others).withColumn("rank", F.row_number().over(Window.partitionBy("n", "key").orderBy("id"))).where(F.col("rank") <= k)
    low = low.groupBy("n", "key").agg(F.collect_list("id").alias("ids"))
    same = keyed(s1).join(low, ["n", "key"]).select(F.col("id").alias(PAIR[0]), F.explode("ids").alias(PAIR[1]), F.lit(1.0).alias("score"))
    return TokenIndex(others, k, rare=rare).search(s1).unionByName(same)
