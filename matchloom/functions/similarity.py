"""Similarities of strings, token sets and vectors as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lev_ratio(a: str | Column, b: str | Column) -> Column:
    """1 - Levenshtein distance / longer length, in code points; 1 for two empty strings."""
    a, b = _c(a), _c(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def lev_above(a: str | Column, b: str | Column, tenths: int = 9) -> Column:
    """lev_ratio > tenths / 10 in whole numbers; the distance is cut off at the longest that can pass."""
    a, b = _c(a), _c(b)
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor(((10 - tenths) * longer - 1) / 10).cast("int")
    d = F.call_function("levenshtein", a, b, F.greatest(most, F.lit(0)))
    return (longer == 0) | ((d >= 0) & (d * 10 < (10 - tenths) * longer))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays without repeats: 1 if both are empty, 0 if one is."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def common(a: str | Column, b: str | Column) -> Column:
    """The number of elements in both arrays."""
    return F.size(F.array_intersect(_c(a), _c(b)))


def postal_cmp(a: str | Column, b: str | Column) -> Column:
    """1 equal, -1 different, 0 if either is missing."""
    a, b = _c(a), _c(b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.lit(-1.0))


def length_diff(a: str | Column, b: str | Column) -> Column:
    return F.abs(F.length(_c(a)) - F.length(_c(b)))


def same(a: str | Column, b: str | Column) -> Column:
    return (_c(a) == _c(b)).cast("int")


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product in double precision; the cosine of unit vectors."""
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def boosted(found: str | Column, sim: str | Column, least: float = 0.88) -> Column:
    """Score of a name match: the largest of what was found, its similarity and ``least``."""
    return F.greatest(F.coalesce(_c(found), F.lit(0.0)), _c(sim), F.lit(least))
