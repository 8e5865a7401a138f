"""Pairs that share a rare name token or a whole name, each made once and where its records meet: no pair is shuffled.

Records that agree in all the fields that a plan reads are dealt by hash into *chunks* of about ``CHUNK`` ids, so copies are
compared once a chunk and no row holds a whole group.  Two chunks meet at each rare token that both have and are kept at
the first of them alone, so nothing is made distinct afterwards.  Equal names have equal tokens, hence equal rare tokens:
names with a rare token meet there already, and only the names without any are joined by the name itself.

Ids are unique (``unique_ids``); callers make the pairs distinct, or take the plain way, where they aren't.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import kept
from . import grid
from .skew import balanced_join

#: Ids of a chunk, about.
CHUNK = 64
#: in_cells: rows of a side of a cell, and of the cells that a task takes at a time, about.
SIDE, ROWS = 256, 1024
#: Pairs of a cell that is not worth a product of its own.
FEW = 1024
PAIR = ["source1_entity_id", "candidate_entity_id"]


def unique_ids(*sides: DataFrame) -> bool:
    """Whether no id is repeated within a side."""
    return all(rows.groupBy("entity_id").count().where("count > 1").isEmpty() for rows in sides)


def chunks(rows: DataFrame, more: list[str], tag: str) -> DataFrame:
    """(n, name, tokens, *more, ids, chunk) with a tag behind each name but n: records that agree in all fields, about CHUNK a row."""
    own = rows.select(F.col("country_norm").alias("n"), F.col("norm_name").alias("name"), F.col("name_tokens").alias("tokens"), *more, F.col("entity_id").alias("id"))
    fields = ["n", "name", "tokens", *more]
    own = own.withColumn("h", F.xxhash64(*fields))  # groups of one hash are dealt alike, no more
    large = own.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK)
    part = F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("m") / CHUNK), F.lit(1)))
    made = own.join(large, "h", "left").withColumn("part", part).groupBy("h", "part", *fields).agg(F.collect_list("id").alias("ids"))
    return made.select("n", *(F.col(c).alias(f"{c}_{tag}") for c in [*fields[1:], "ids"]), F.xxhash64("h", "part").alias(f"chunk_{tag}"))


def with_keys(rows: DataFrame, rare: DataFrame, tag: str) -> DataFrame:
    """rows with keys_tag: their rare tokens in order of (df, token), an empty array for none."""
    tokens = f"tokens_{tag}"
    each = rows.select("n", tokens).distinct().select("n", tokens, F.explode(tokens).alias("token")).join(rare.select("n", "token", "df"), ["n", "token"])
    keys = each.groupBy("n", tokens).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("o")).select("n", tokens, F.col("o.token").alias("keys"))
    none = F.array().cast("array<string>")
    return rows.join(keys, ["n", tokens], "left").withColumn(f"keys_{tag}", F.coalesce("keys", none)).drop("keys")


def keyed(s1: DataFrame, others: DataFrame, rare: DataFrame, more: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Both sides as stored chunks with keys."""
    rare = kept(rare.select("n", "token", "df"), "met-rare")
    return kept(with_keys(chunks(s1, more, "a"), rare, "a"), "met-a"), kept(with_keys(chunks(others, more, "b"), rare, "b"), "met-b")


def by_token(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chunks of both sides that share a rare token, once, at the first token (df, token) that they share: ``key``."""
    left, right = a.withColumn("key", F.explode("keys_a")), b.withColumn("key", F.explode("keys_b"))
    met = balanced_join(left, right, ["n", "key"], "chunk_a", "chunk_b")
    return met.where(F.array_intersect("keys_a", "keys_b")[0] == F.col("key"))


def same_key(tag: str, tokens: bool) -> Column:
    """The key of equal names of three characters or more; with ``tokens``, of equal significant tokens where there are any."""
    name, own = F.col(f"name_{tag}"), F.col(f"tokens_{tag}")
    key = F.concat(F.lit("n"), name)
    if tokens:
        key = F.when(F.size(own) > 0, F.concat(F.lit("t"), X.sorted_key(own))).otherwise(key)
    return F.when(F.length(name) >= 3, key)


def by_name(a: DataFrame, b: DataFrame, tokens: bool = False) -> DataFrame:
    """Chunks of both sides with equal names or, if asked, equal tokens."""
    left, right = (x.withColumn("key", same_key(t, tokens)).where("key is not null") for x, t in ((a, "a"), (b, "b")))
    return balanced_join(left, right, ["n", "key"], "chunk_a", "chunk_b")


def by_either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chunks that share a rare token or a whole name, with ``shared`` tokens counted."""
    rest = by_name(a.where(F.size("keys_a") == 0), b.where(F.size("keys_b") == 0))
    both = by_token(a, b).unionByName(rest)
    return both.drop("key").withColumn("shared", F.size(F.array_intersect("tokens_a", "tokens_b")))


def in_cells(a: DataFrame, b: DataFrame, of_pairs: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], dict[str, np.ndarray]] | None = None, schema: str = "", fields: list[str] = [], names: bool = True, gather: bool = True, sizes: bool = False) -> DataFrame:  # noqa: B006
    """by_either, or by_token without ``names``, as (ids_a, ids_b, *schema): of_pairs(rows of a, rows of b, i, j) gives the columns of
    the pairs of chunks (i, j) that meet.

    Chunks meet in cells (operators.grid), whose pairs are told by a product of matrices: no row per pair and token is made or joined.
    of_pairs sees ``fields`` without their tags.  ``gather``: chunks that meet one of a cell with equal columns are one row; with
    ``sizes`` that row has chunk_a and m, the number of ids_b, in place of the ids.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = "chunk_a bigint, m bigint" if sizes else "ids_a array<string>, ids_b array<string>"
    whole += f", {schema}" if schema else ""
    arrow = to_arrow_schema(StructType.fromDDL(whole))

    def side(rows: DataFrame, tag: str) -> DataFrame:
        keys, none = F.col(f"keys_{tag}"), F.array().cast("array<bigint>")
        ids = F.size(f"ids_{tag}").cast("long").alias("m") if sizes else F.col(f"ids_{tag}").alias("ids")
        own = [ids, *(F.col(f"{c}_{tag}").alias(c) for c in ("chunk", *fields))]
        tokens = rows.select("*", F.posexplode(keys).alias("at", "token"))
        tokens = tokens.select(F.concat("n", F.lit("\nt"), "token").alias("key"), F.transform(F.slice(keys, 1, F.col("at")), lambda t: F.xxhash64(t)).alias("before"), *own)
        if not names:
            return tokens
        named = rows.where(F.size(keys) == 0).select(F.concat("n", F.lit("\n"), same_key(tag, False)).alias("key"), none.alias("before"), *own)
        return tokens.unionByName(named.where("key is not null"))

    def of_bucket(x: pa.Table, y: pa.Table, cells: np.ndarray) -> pa.Table:
        before = [z["before"].combine_chunks() for z in (x, y)]
        row, col = [], []
        for s, e, t, g in cells[large := (cells[:, 1] - cells[:, 0]) * (cells[:, 3] - cells[:, 2]) > FEW].tolist():
            p, q = before[0].slice(s, e - s), before[1].slice(t, g - t)
            seen = np.intersect1d(p.flatten().to_numpy(), q.flatten().to_numpy())
            i, j = np.nonzero(_has(p, seen) @ _has(q, seen).T == 0)
            row.append(i + s)
            col.append(j + t)
        s, e, t, g = cells[~large].T
        many, wide = (e - s) * (g - t), g - t  # the pairs of small cells are told together
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        s, t, wide = (np.repeat(c, many) for c in (s, t, wide))
        i, j = s + at // wide, t + at % wide
        first = shared(*before, i, j) == 0
        i, j = np.concatenate([*row, i[first]]), np.concatenate([*col, j[first]])
        made = of_pairs(x, y, i, j) if of_pairs else {}
        made = [made[f.name] for f in list(arrow)[2:]]
        if gather:
            order = np.lexsort((*made, i)) if made else np.arange(len(i))  # rows are in order, as a row is in one cell
            i, j, made = i[order], j[order], [c[order] for c in made]
            new = np.ones(len(i), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in (i, *made)], axis=0) if len(i) else True
            first = np.flatnonzero(new)
            i, made = i[first], [c[first] for c in made]
            if sizes:
                left, right = x["chunk"].take(pa.array(i)), pa.array(np.add.reduceat(y["m"].to_numpy()[j], first) if len(first) else np.zeros(0, np.int64))
            else:
                met = y["ids"].combine_chunks().take(pa.array(j))
                ends = np.append(met.offsets.to_numpy()[first], len(met.flatten())).astype(np.int32)
                left, right = x["ids"].combine_chunks().take(pa.array(i)), pa.ListArray.from_arrays(pa.array(ends), met.flatten())
        else:
            left, right = (z["ids"].combine_chunks().take(pa.array(k)) for z, k in ((x, i), (y, j)))
        return pa.table([left, right, *map(pa.array, made)], names=arrow.names).cast(arrow)

    return grid.in_cells(side(a, "a"), side(b, "b"), "key", "chunk", "chunk", of_bucket, whole, SIDE, ROWS, together=True)


def scores(x: pa.Table, y: pa.Table, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """prob of the pairs of chunks: the Jaccard of their name tokens to 6 digits, 1 if neither has any."""
    both, m, n = shared(x["tokens"].combine_chunks(), y["tokens"].combine_chunks(), i, j), *(pc.list_value_length(t["tokens"]).to_numpy()[k] for t, k in ((x, i), (y, j)))
    return {"prob": rounded(np.where(m + n == 0, 1.0, both / np.maximum(m + n - both, 1)))}


def rounded(ratios: np.ndarray) -> np.ndarray:
    """Ratios of small numbers to 6 digits; halves go up, and others are further from a half than what is added."""
    return np.floor(ratios * 1e6 + 0.5 + 1e-6) / 1e6


def equal(x: pa.Array, y: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether strings x[i] and y[j] are equal; nulls equal nothing."""
    p, q = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
    codes, _ = pd.factorize(np.concatenate([p, q]))
    p, q = codes[: len(p)][i], codes[len(p) :][j]
    return (p == q) & (p >= 0)


def _has(lists: pa.Array, words: np.ndarray) -> np.ndarray:
    """A row per list, a column per word, 1 where the list has the word; words are sorted."""
    out = np.zeros((len(lists), len(words)), np.float32)
    if len(words):
        flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        good = words[at] == flat
        out[row[good], at[good]] = 1
    return out


def shared(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements lists a[i] and b[j] have in common, by bits for the elements that both sides have."""
    p, q = (x.flatten().to_numpy(zero_copy_only=False) for x in (a, b))
    codes, _ = pd.factorize(np.concatenate([p, q]))
    p, q = codes[: len(p)], codes[len(p) :]
    known = np.intersect1d(p, q)

    def bits(lists: pa.Array, own: np.ndarray) -> np.ndarray:
        out = np.zeros((-(-len(known) // 64), len(lists)), np.uint64)
        row, at = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), np.searchsorted(known, own)
        good = at < len(known)
        good[good] = known[at[good]] == own[good]
        np.bitwise_or.at(out, (at[good] // 64, row[good]), np.uint64(1) << (at[good] % 64).astype(np.uint64))
        return out

    out = np.zeros(len(i), np.int64)
    for x, y in zip(bits(a, p), bits(b, q), strict=True):
        out += np.bitwise_count(x[i] & y[j])
    return out


def jaccard() -> Column:
    """Of the tokens of two chunks that met: 1 if neither has any."""
    a, b, shared = F.size("tokens_a"), F.size("tokens_b"), F.col("shared")
    return F.when(a + b == 0, F.lit(1.0)).otherwise(shared / (a + b - shared))


def pairs(met: DataFrame, *columns: Column | str) -> DataFrame:
    """The pairs of records of chunks that met, with columns of their own."""
    first = met.select(F.explode("ids_a").alias(PAIR[0]), "ids_b", *columns)
    rest = [c for c in first.columns if c not in (PAIR[0], "ids_b")]
    return first.select(PAIR[0], F.explode("ids_b").alias(PAIR[1]), *rest)
