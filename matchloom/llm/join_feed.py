"""Documents and labels as streams of changes: rows that appear, go and are updated in numbered batches.

What happens to a row in batch t is told by c(t), the unsigned crc32 of ``prefix:doc_id:t``: rows with c(0) mod 3 = 0
start absent; c(t) mod 19 = 0 deletes a present row or inserts an absent one, which keeps its earlier updates; 1 updates a
present row.  A null doc_id is written ``null``; its join_key is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .zset import plus, zset


def event(prefix: str, batch: int, id_col: str = "doc_id") -> Column:
    number = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.crc32(F.concat(F.lit(f"{prefix}:"), number, F.lit(f":{batch}")))


def states(prefix: str, batch: int) -> tuple[Column, Column]:
    """(present, updates so far) of a row after a batch."""
    present, updates = F.pmod(event(prefix, 0), F.lit(3)) != 0, F.lit(0)
    for t in range(1, batch + 1):
        what = F.pmod(event(prefix, t), F.lit(19))
        updates = updates + F.when((what == 1) & present, 1).otherwise(0)
        present = F.when(what == 0, ~present).otherwise(present)
    return present, updates


def printed(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null"))


def document_rows(rows: DataFrame, updates: Column) -> DataFrame:
    """(join_key, doc_part): the key moves by one with each update."""
    return rows.select((F.floor(F.col("doc_id") / 3) + updates).cast("long").alias("join_key"), printed("lang").alias("doc_part"))


def label_rows(rows: DataFrame, updates: Column) -> DataFrame:
    """(join_key, label_part): each update turns quality into 1 - quality."""
    quality = F.when(updates % 2 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))
    return rows.select(F.floor(F.col("doc_id") / 3).cast("long").alias("join_key"), F.concat_ws(",", printed(quality), printed("toxic")).alias("label_part"))


def changes(rows: DataFrame, prefix: str, batch: int, made) -> DataFrame:
    """The Z-set of a batch's changes; batch 0 is the table as it starts."""
    present, updates = states(prefix, batch)
    after = zset(made(rows.where(present), updates))
    if batch == 0:
        return after
    was, before = states(prefix, batch - 1)
    touched = rows.where(F.pmod(event(prefix, batch), F.lit(19)) < 2)
    return plus(zset(made(touched.where(present), updates)), zset(made(touched.where(was), before), -1))
