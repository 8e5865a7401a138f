"""Exact deduplication with counting quotient filters.

Each partition builds a counting quotient filter of its texts' fingerprints: the high bits (the
quotient) say in which run a fingerprint's low bits (the remainder) stand, runs are sorted by
remainder, and each entry has a count.  Nothing is lost, so filters merge exactly by merging sorted
remainders.  Filters travel in blocks of neighbouring quotients, one merge task per block.
Fingerprints with a merged count above one route their texts to byte verification: a grouping by the
text itself, with partial aggregation, so a hot text crosses the network once per task.

Null texts count as empty, and empty texts are equal to one another.  Rows that repeat id and text are
rows of one group; each of them returns a row, and those with the largest doc_id are kept.  A null
doc_id is smaller than any other.  An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_and_text, stored

FINGERPRINT_BITS = 64
#: Entries that a merged block holds on average.
BLOCK_ENTRIES = 1 << 15
#: Repeated fingerprints of up to this many bytes are broadcast to the scan; beyond it they join by shuffle.
BROADCAST_BYTES = 16 << 20

BLOCKS = "block int, runs binary, remainders binary, counts binary"


class CountingQuotientFilter:
    """Sorted runs of remainders with counts, one run per quotient; a block of a larger filter."""

    def __init__(self, r_bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.r_bits, self.runs, self.remainders, self.counts = r_bits, runs, remainders, counts

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray, q_bits: int, r_bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints of q_bits + r_bits bits."""
        quotients = (prints >> np.uint64(r_bits)).astype(np.int64) if r_bits < 64 else np.zeros(len(prints), np.int64)
        mask = np.uint64((1 << r_bits) - 1)
        return cls(r_bits, np.bincount(quotients, minlength=1 << q_bits).astype("<u4"), (prints & mask).astype("<u8"), counts.astype("<i8"))

    @classmethod
    def load(cls, r_bits: int, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        return cls(r_bits, np.frombuffer(runs, "<u4"), np.frombuffer(remainders, "<u8"), np.frombuffer(counts, "<i8"))

    def prints(self) -> np.ndarray:
        """The fingerprints, ascending: quotient and remainder put together again."""
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return ((quotients << np.uint64(self.r_bits)) | self.remainders) if self.r_bits < 64 else self.remainders.astype(np.uint64)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both inputs: the sorted remainders of a run are merged, and counts of equal ones add.

        An entry's place is its own rank and the number of the other's entries before it, so nothing is sorted: runs
        that one side has alone move as they are, and within the others each remainder finds its place by bisection.
        """
        ahead = self._before(other)
        mine = np.arange(len(self.remainders)) + ahead
        theirs = np.ones(len(self.remainders) + len(other.remainders), bool)
        theirs[mine] = False
        remainders, counts = np.empty(len(theirs), "<u8"), np.empty(len(theirs), "<i8")
        runs = np.empty(len(theirs), np.int64)
        for at, x in ((mine, self), (np.flatnonzero(theirs), other)):
            remainders[at], counts[at], runs[at] = x.remainders, x.counts, np.repeat(np.arange(len(x.runs)), x.runs)
        first = np.flatnonzero(np.concatenate([[True], (remainders[1:] != remainders[:-1]) | (runs[1:] != runs[:-1])])) if len(runs) else np.zeros(0, np.int64)
        merged = np.add.reduceat(counts, first) if len(first) else counts
        return CountingQuotientFilter(self.r_bits, np.bincount(runs[first], minlength=len(self.runs)).astype("<u4"), remainders[first], merged.astype("<i8"))

    def _before(self, other: CountingQuotientFilter) -> np.ndarray:
        """For each entry, how many entries of the other filter stand before it: by bisection in its run."""
        starts = np.cumsum(other.runs.astype(np.int64)) - other.runs
        run = np.repeat(np.arange(len(self.runs)), self.runs)
        low, high = starts[run], starts[run] + other.runs[run]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (other.remainders[np.minimum(middle, len(other.remainders) - 1)] < self.remainders)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    def row(self, block: int) -> tuple:
        return block, self.runs.tobytes(), self.remainders.tobytes(), self.counts.tobytes()


def filter_blocks(prints: DataFrame, bits: int, block_bits: int, run_bits: int = 8) -> DataFrame:
    """The blocks of the merged filter of a table with one column fp (long, ``bits`` bits used).

    block_bits high bits choose the block, run_bits more the run in it; the rest are remainders.
    """
    block_bits = min(block_bits, bits)
    run_bits = min(run_bits, bits - block_bits)
    inner, r_bits = bits - block_bits, bits - block_bits - run_bits
    schema = pa.schema([("block", pa.int32()), ("runs", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())])

    def build(batches):
        held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting, size = [], 0

        def fold():
            some = np.concatenate([held, *waiting])
            seen, at = np.unique(some, return_inverse=True)
            return seen, np.bincount(at, np.concatenate([counts, np.ones(size, np.int64)]), len(seen)).astype(np.int64)

        for b in batches:
            waiting.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += b.num_rows
            if size > max(1 << 18, len(held)):
                held, counts = fold()
                waiting, size = [], 0
        held, counts = fold()
        if not len(held):
            return
        blocks = (held >> np.uint64(inner)).astype(np.int64) if inner < 64 else np.zeros(len(held), np.int64)
        low = held & np.uint64((1 << inner) - 1)
        starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        rows = []
        for s, e in zip(starts, [*starts[1:], len(held)], strict=True):
            rows.append(CountingQuotientFilter.of(low[s:e], counts[s:e], run_bits, r_bits).row(int(blocks[s])))
            if len(rows) == 256:
                yield batch_of(schema, *zip(*rows, strict=True))
                rows = []
        if rows:
            yield batch_of(schema, *zip(*rows, strict=True))

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [CountingQuotientFilter.load(r_bits, *x) for x in zip(pdf.runs, pdf.remainders, pdf.counts, strict=True)]
        while len(parts) > 1:
            parts = [parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return pd.DataFrame([parts[0].row(int(key[0]))], columns=["block", "runs", "remainders", "counts"])

    return prints.mapInArrow(build, BLOCKS).groupBy("block").applyInPandas(merge, BLOCKS)


def repeated_prints(blocks: DataFrame, bits: int, block_bits: int, run_bits: int = 8) -> DataFrame:
    """fp (long) and n of the filter's entries with a count above one."""
    block_bits = min(block_bits, bits)
    run_bits = min(run_bits, bits - block_bits)
    inner, r_bits = bits - block_bits, bits - block_bits - run_bits
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int64())])

    def above_one(batches):
        for b in batches:
            for block, runs, remainders, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = CountingQuotientFilter.load(r_bits, runs, remainders, counts)
                high = np.uint64((block << inner) & ((1 << 64) - 1)) if inner < 64 else np.uint64(0)
                many = part.counts > 1
                yield batch_of(schema, (part.prints()[many] | high).view(np.int64), part.counts[many])

    return blocks.mapInArrow(above_one, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_bits: int = FINGERPRINT_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    fingerprint_bits below 64 makes fingerprints of different texts meet; results stay the same.
    """
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col).withColumn("fp", F.shiftrightunsigned(F.xxhash64("text"), 64 - fingerprint_bits))
    digests = stored(base.select("doc_id", "fp", F.sha2("text", 256).alias("sha")), "exact-digests")
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, -(-digests.count() // BLOCK_ENTRIES), 2)
    block_bits = min((wanted - 1).bit_length(), 30)
    blocks = stored(filter_blocks(digests.select("fp"), fingerprint_bits, block_bits), "exact-filter")
    repeated = stored(repeated_prints(blocks, fingerprint_bits, block_bits), "exact-repeated").select("fp")
    if repeated.count() * 16 <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)
    # Byte verification: texts of equal fingerprints are grouped by their bytes.
    same = base.join(repeated, "fp", "left_semi").groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(same.where("group_size > 1").select("fp", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"), "exact-groups")
    out = digests.join(groups, ["fp", "sha"], "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
