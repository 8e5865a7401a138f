"""Incremental maintenance of joins as a circuit over weighted tables.

A Z-set is a table with a whole-number column ``weight``: how many copies of the row there are (negative in changes).
A stream is a sequence of Z-sets, one a batch; each node of a circuit takes a batch's input and gives its output:

- ``Delay``: the input of the batch before.
- ``Integrate``: the sum of all inputs so far.  ``Differentiate``: the input less the one before.
- ``Join``: the change of a join, bilinear in its sides: (A + dA) x dB + dA x B, where A and B are delayed integrals.
- ``Distinct``: the change of the set of rows with a positive count; only keys of the change are looked up.
- ``RightOuterJoin``: Join, and right rows without a partner padded: dR - change of (R x distinct keys of L).

An integral isn't rewritten by each batch: it is a base and the changes since, all stored in the shared folder, which are
read together (joins and sums are linear, so they need no merging first).  Once the changes outgrow half of the base
they are merged into a new base, so what is written over time stays in proportion to what arrives.

Rows are added up by all their columns before they are joined or shuffled on a key, so a key that holds a third of all
rows meets as its distinct rows.  Joins are by shuffle: nothing that grows is broadcast, gathered or sent to the driver,
and AQE splits what is skewed.

Null keys join nothing; a right row with a null key is padded.  Rows that repeat are one row with that weight.  Empty
batches and tables give empty changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

WEIGHT = "weight"
#: Changes are merged into the base of an integral once their rows exceed this share of it.
MERGE_SHARE = 0.5


def zset(rows: DataFrame, weight: Column | int = 1) -> DataFrame:
    """Rows with a weight, one if none is given."""
    return rows.withColumn(WEIGHT, (weight if isinstance(weight, Column) else F.lit(weight)).cast("long"))


def columns_of(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != WEIGHT]


def consolidate(z: DataFrame) -> DataFrame:
    """Equal rows as one, with the sum of their weights; rows of weight zero go."""
    return z.groupBy(*columns_of(z)).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def plus(*zs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, zs)


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(WEIGHT, -F.col(WEIGHT))


def empty_like(z: DataFrame) -> DataFrame:
    return z.sparkSession.createDataFrame([], z.schema)


def bilinear(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The join of two Z-sets on a key: columns of both, weights multiplied."""
    a, b = (z.withColumnRenamed(WEIGHT, name) for z, name in ((left, "__wa"), (right, "__wb")))
    return a.join(b.hint("shuffle_merge"), key).withColumn(WEIGHT, F.col("__wa") * F.col("__wb")).drop("__wa", "__wb")


class Delay:
    """z^-1: gives the input of the batch before, at first nothing."""

    def __init__(self):
        self.last: DataFrame | None = None

    def step(self, z: DataFrame) -> DataFrame:
        before = self.last if self.last is not None else empty_like(z)
        self.last = z
        return before


class Integrate:
    """The sum of all inputs: x + delay(integral).  ``before`` is the delayed integral while a batch is worked on.

    The integral is a list of stored layers, a base and changes; ``step`` adds the batch's change as a layer.
    """

    def __init__(self, tag: str, merge_share: float = MERGE_SHARE):
        self.tag, self.merge_share = tag, merge_share
        self.layers: list[tuple[DataFrame, int]] = []

    def before(self, like: DataFrame) -> DataFrame:
        return plus(*(z for z, _ in self.layers)) if self.layers else empty_like(like)

    def step(self, z: DataFrame) -> DataFrame:
        """``z`` is a stored table; it becomes a layer.  Returns the new integral."""
        self.layers.append((z, z.count()))
        return self.before(z)

    def settle(self) -> None:
        """Merge the changes into the base where they have outgrown their share; no plan of a batch may be open."""
        base, changes = self.layers[:1], self.layers[1:]
        if changes and sum(n for _, n in changes) > self.merge_share * max(1, base[0][1]):
            old = self.layers
            merged = stored(consolidate(self.before(base[0][0])), self.tag)
            self.layers = [(merged, merged.count())]
            for z, _ in old:
                discard(z)


class Differentiate:
    """x - delay(x): changes of a stream of whole states."""

    def __init__(self):
        self.delay = Delay()

    def step(self, z: DataFrame) -> DataFrame:
        return consolidate(plus(z, negate(self.delay.step(z))))


class Join:
    """The change of L x R on a key: (L + dL) x dR + dL x R, of the delayed integrals L and R."""

    def __init__(self, key: str):
        self.key = key

    def step(self, left: DataFrame, right: DataFrame, left_before: DataFrame, right_before: DataFrame) -> DataFrame:
        return plus(bilinear(plus(left_before, left), right, self.key), bilinear(left, right_before, self.key))


class Distinct:
    """The change of the indicator of rows with a positive count: 1 where one appears, -1 where the last one goes."""

    def step(self, z: DataFrame, before: DataFrame) -> DataFrame:
        cols = columns_of(z)
        # Only rows of the change are looked up; a null is a value of its own here.
        touched = z.select(*cols).distinct().hint("shuffle_merge")
        same = reduce(lambda a, b: a & b, (before[c].eqNullSafe(touched[c]) for c in cols))
        old = before.join(touched, same, "left_semi").select(*cols, F.col(WEIGHT).alias("old"), F.lit(0).cast("long").alias("new"))
        both = old.unionByName(z.select(*cols, F.lit(0).cast("long").alias("old"), F.col(WEIGHT).alias("new")))
        sums = both.groupBy(*cols).agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
        change = (F.col("old") + F.col("new") > 0).cast("long") - (F.col("old") > 0).cast("long")
        return sums.select(*cols, change.alias(WEIGHT)).where(F.col(WEIGHT) != 0)


class RightOuterJoin:
    """The right outer join of two streams of changes: a batch's changes in, the joined rows' changes out.

    ``key`` is the only column that both sides have; ``pad`` gives the left columns of a right row without a partner
    (null if it names none).  ``step`` returns the batch's changed rows: their columns, weight (copies after less
    copies before) and total (copies after), stored in the shared folder.
    """

    def __init__(self, key: str, pad: dict[str, Column] | None = None, merge_share: float = MERGE_SHARE):
        self.key, self.pad = key, pad or {}
        self.join, self.padding, self.distinct = Join(key), Join(key), Distinct()
        self.left, self.right, self.present, self.out = (Integrate(f"zset-{t}", merge_share) for t in ("left", "right", "present", "out"))

    def step(self, left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = stored(consolidate(left), "zset-dl"), stored(consolidate(right), "zset-dr")
        before = {"left": self.left.before(left), "right": self.right.before(right)}
        # Presence indicators of the left keys, whose counts are the left rows added up by key.
        of_keys = lambda z: z.where(F.col(self.key).isNotNull()).select(self.key, WEIGHT)
        keys = stored(self.distinct.step(of_keys(left), of_keys(before["left"])), "zset-dk")
        present = self.present.before(keys)
        inner = self.join.step(left, right, before["left"], before["right"])
        partnered = self.padding.step(keys, right, present, before["right"])
        lone = plus(right, negate(partnered.select(*right.columns)))
        fields = {f.name: f.dataType for f in left.schema if f.name not in (self.key, WEIGHT)}
        padded = lone.select(*lone.columns, *(self.pad.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()))
        change = stored(consolidate(plus(inner, padded.select(*inner.columns))), "zset-do")
        # Copies after: those of the changed rows before, and the change.
        cols = columns_of(change)
        both = plus(self._same_key(self.out.before(change), change).select(*cols, F.lit(0).cast("long").alias(WEIGHT), F.col(WEIGHT).alias("total")), change.select(*cols, WEIGHT, F.col(WEIGHT).alias("total")))
        rows = both.groupBy(*cols).agg(F.sum(WEIGHT).alias(WEIGHT), F.sum("total").alias("total")).where(F.col(WEIGHT) != 0)
        result = stored(rows, "zset-result")
        for node, z in ((self.left, left), (self.right, right), (self.present, keys), (self.out, change)):
            node.step(z)
            node.settle()
        return result

    def _same_key(self, state: DataFrame, change: DataFrame) -> DataFrame:
        """The rows of a state whose key, null too, occurs in a change."""
        keys = change.select(F.col(self.key).alias("__key")).distinct().hint("shuffle_merge")
        return state.join(keys, F.col(self.key).eqNullSafe(F.col("__key")), "left_semi")
