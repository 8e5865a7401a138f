"""Rows of two sides that share a key meet in cells of bounded size, so pairs are made in tasks and never shuffled.

A key with more than ``side`` rows on either side is dealt over a grid: a cell holds about ``side`` rows of both sides at most, and
each pair of a key's rows meets in one cell.  What is shuffled is a row per row and cell, a ``side``-th of the pairs; a task takes cells
of about ``rows`` rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept

#: Rows of a side of a cell, and of the cells that a task takes at a time, about.
SIDE, ROWS = 256, 2048


def dealt(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str, side: int = SIDE) -> tuple[DataFrame, DataFrame, int, int]:
    """(left, right, rows of both, pairs): both sides with ``cell``, without the rows whose key the other lacks.

    Both are read twice: give stored ones.  Null keys meet nothing.
    """
    size = lambda rows, c: rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(c))
    counts = kept(size(left, "a").join(size(right, "b"), key).select(key, "a", "b", F.ceil(F.col("a") / side).alias("__rows"), F.ceil(F.col("b") / side).alias("__cols")), "grid-keys")
    copies, pairs = counts.agg(F.sum(F.col("a") * F.col("__cols") + F.col("b") * F.col("__rows")), F.sum(F.col("a") * F.col("b"))).first()  # two numbers
    grids = F.broadcast(counts.where("__rows > 1 or __cols > 1").select(key, "__rows", "__cols"))  # fewer than rows / side
    one = lambda c: F.coalesce(F.col(c), F.lit(1).cast("bigint"))
    own = lambda by, c: F.pmod(F.xxhash64(by), one(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), one(c) - 1))
    cell = F.concat_ws("\n", key, "__row", "__col").alias("cell")

    def cells(rows: DataFrame, by: str, at: tuple[str, str], to: tuple[str, str]) -> DataFrame:
        met = rows.join(counts.select(key), key, "left_semi").join(grids, key, "left")
        return met.withColumn(at[0], own(by, at[1])).withColumn(to[0], every(to[1])).select(*rows.columns, cell)

    row, col = ("__row", "__rows"), ("__col", "__cols")
    return cells(left, left_by, row, col), cells(right, right_by, col, row), int(copies or 0), int(pairs or 0)


def in_cells(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str, f: Callable[..., pa.Table], schema: str, side: int = SIDE, rows: int = ROWS, more: tuple[DataFrame, DataFrame] | None = None, together: bool = False) -> DataFrame:
    """f(rows of the left, rows of the right) of every cell, as Arrow tables of ``schema``.

    ``together``: f takes the rows of several cells and, a row per cell, (start, end) on the left and on the right.
    ``more`` has wide columns of both sides by ``left_by`` and ``right_by``; they are joined when rows have their cells.
    """
    a, b, copies, _ = dealt(left, right, key, left_by, right_by, side)
    if more:
        a, b = (x.drop(key).join(y, by) for x, y, by in ((a, more[0], left_by), (b, more[1], right_by)))
    many = max(1, -(-copies // rows))
    bucket = F.pmod(F.xxhash64("cell"), F.lit(many)).alias("bucket")
    tasks = min(many, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // 8)))
    named = lambda x: [F.col(c).alias(c) for c in x.columns]  # noqa: E731  both sides may come from one table
    a, b = (x.select(bucket, *named(x)).repartition(tasks, "bucket") for x in (a, b))  # few bytes are much work

    def both(x: pa.Table, y: pa.Table):
        codes, _ = pd.factorize(np.concatenate([x["cell"].to_numpy(), y["cell"].to_numpy()]))
        p, q = codes[: len(x)], codes[len(x) :]
        i, j = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
        p, q, x, y = p[i], q[j], x.take(pa.array(i)), y.take(pa.array(j))
        c = np.intersect1d(p, q)
        at = np.stack([np.searchsorted(z, c, side) for z in (p, q) for side in ("left", "right")], axis=1)
        if together:
            return f(x, y, at) if len(at) else empty
        made = [f(x.slice(s, e - s), y.slice(t, g - t)) for s, e, t, g in at.tolist()]
        return pa.concat_tables(made) if made else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return a.groupBy("bucket").cogroup(b.groupBy("bucket")).applyInArrow(both, schema)
