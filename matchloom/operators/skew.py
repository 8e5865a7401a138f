"""Equi-joins whose work per task stays even, whatever share of the rows a key has.

The work of a key is its rows on both sides and the pairs that they make.  A key with more than ``HEAVY`` of a task's even
share is dealt over a grid: one side's rows over the grid's rows and copied to its columns, the other side's the other
way round, so that each pair meets in one cell.  There are fewer than tasks / HEAVY such keys, whatever the
table, so their sizes, and nothing else, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept

#: Share of a task's even work that makes a key heavy, and that a cell of its grid has at most, about.
HEAVY, CELL = 0.25, 0.125
#: Rows and pairs of a whole join that need no dealing: a task does them in about a second.
LIGHT = 1_000_000


def heavy_keys(left: DataFrame, right: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame | None:
    """(keys, __rows, __cols): the grid of each key that has too much work for one task, fewer than tasks / HEAVY; None
    if no key has."""
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (rows.groupBy(*keys).agg(F.count("*").cast("double").alias(n)) for rows, n in ((left, "a"), (right, "b")))
    work = a.join(b, keys).withColumn("work", F.col("a") + F.col("b") + F.col("a") * F.col("b"))
    total, most = work.agg(F.sum("work"), F.max("work")).first()  # two numbers
    if not total or total <= LIGHT or most <= HEAVY * total / tasks:
        return None
    even = total / tasks
    heavy = kept(work.where(F.col("work") > HEAVY * even), "skew-heavy")
    cells = F.ceil(F.col("work") / (CELL * even))
    # The grid is shaped as the sides are, so that about as many rows are copied of either.
    high = F.least(F.col("a"), F.greatest(F.lit(1.0), F.ceil(F.sqrt(cells * F.col("a") / F.col("b")))))
    wide = F.least(F.col("b"), F.greatest(F.lit(1.0), F.ceil(cells / high)))
    return heavy.select(*keys, high.cast("int").alias("__rows"), wide.cast("int").alias("__cols"))


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], left_by: str, right_by: str, tasks: int | None = None) -> DataFrame:
    """The inner join of both sides on keys; rows of heavy keys are dealt by the hashes of ``left_by`` and ``right_by``.

    Both sides are read twice: give stored or cheap ones.  Null keys join nothing.  Neither side is broadcast: stored rows that
    repeat have files far smaller than what the driver would hold of them.
    """
    grids = heavy_keys(left, right, keys, tasks)
    if grids is None:
        return left.hint("merge").join(right, keys)
    grids = F.broadcast(grids)  # fewer than tasks / HEAVY rows
    cell = lambda by, n: F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    a = left.join(grids, keys, "left").withColumn("__row", cell(left_by, F.col("__rows"))).withColumn("__col", every(F.col("__cols")))
    b = right.join(grids, keys, "left").withColumn("__col", cell(right_by, F.col("__cols"))).withColumn("__row", every(F.col("__rows")))
    return a.drop("__rows", "__cols").hint("merge").join(b.drop("__rows", "__cols"), [*keys, "__row", "__col"]).drop("__row", "__col")
