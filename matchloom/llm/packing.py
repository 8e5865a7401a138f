"""Packing along a space-filling curve.

A document's ids are hashed into a vector that is projected to a few dimensions; the Hilbert index of
that point is its key.  Documents are range-sorted by key, and the ids along the curve are cut into
sequences of a fixed length, so neighbours on the curve share sequences and only the very last
sequence can need padding.

Null texts count as empty; an empty text has the end id alone; equal texts have equal keys and are
ordered by doc_id (null first); repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import batch_of, discard, filesystem, id_and_text, shared_dir, slices, stored

SEQUENCE = 2048
DIMS, BITS, BUCKETS, SEED = 3, 12, 1 << 16, 7

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection(dims: int = DIMS, buckets: int = BUCKETS, seed: int = SEED) -> np.ndarray:
    """One row per hash bucket: the columns of a random projection of hashed vectors."""
    return np.random.default_rng(seed).standard_normal((buckets, dims)).astype(np.float32)


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims), 0 <= x < 2**bits, by Skilling's transform of axes.

    The transform works on all points at once; dims * bits must be below 64.
    """
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = np.int64(1) << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.int64(1) << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents from their ids: mean projection of hashed ids, each axis through the
    normal distribution's logistic stand-in so that the grid is used evenly."""
    sizes = np.array([len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.uint32)
    rows = table[((flat * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(len(table))]
    ends = np.cumsum(sizes)
    total = np.add.reduceat(rows, ends - sizes, axis=0, dtype=np.float64)
    unit = 1 / (1 + np.exp(-8 * np.clip(total / sizes[:, None], -5, 5)))
    return hilbert_index(np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS, bits: int = BITS, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of ``sequence`` ids: doc_id, start, length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset and, with ``with_ids``, ids
    (little-endian, the tokenizer's width).

    Texts are tokenised once and their ids are written once.  Only (key, doc_id, n) and where the ids were written are
    sorted along the curve; the positions go back to a file for each file of ids, which the last pass reads beside it.
    Nothing is gathered on the driver.
    """
    tokenizer = tokenizer or tokens.default_path()
    width = tokens.encoder(tokenizer).dtype.itemsize
    keyed = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("ids", pa.binary())])

    def tokenise(batches):
        table, enc = projection(dims), tokens.encoder(tokenizer)
        part, row = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            raw = enc.encode(b.column(1).to_pylist())
            ids = [np.frombuffer(x, enc.dtype) for x in raw]
            yield batch_of(keyed, curve_keys(ids, table, bits), b.column(0), [len(x) for x in ids], [part] * len(ids), range(row, row + len(ids)), raw)
            row += len(ids)

    encoded = stored(id_and_text(docs, id_col, text_col).mapInArrow(tokenise, "key long, doc_id long, n long, part int, row long, ids binary"), "pack-ids")
    at = written_positions(encoded)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), *[("ids", pa.binary())] * with_ids])

    def cut(batches):
        held: dict[int, np.ndarray] = {}
        for b in slices(batches):
            rows = []
            for doc, n, part, row, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part not in held:
                    held = {part: read_positions(at, part)}
                place, start = int(held[part][row]), 0
                while start < n:
                    seq, off = divmod(place + start, sequence)
                    length = min(sequence - off, n - start)
                    piece = ids[start * width : (start + length) * width]
                    crc = zlib.crc32(np.frombuffer(piece, f"<u{width}").astype("<u4"))
                    rows.append((doc, start, length, crc, n, seq, off, *[piece] * with_ids))
                    start += length
            if rows:
                yield batch_of(out, *zip(*rows, strict=True))

    return encoded.select("doc_id", "n", "part", "row", "ids").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def written_positions(encoded: DataFrame) -> str:
    """The folder of files (row, at), one for each ``part`` of a table (key, doc_id, n, part, row): the ids before each
    row's along the curve."""
    placed = pa.schema([("slot", pa.int32()), ("part", pa.int32()), ("row", pa.int64()), ("local", pa.int64()), ("n", pa.int64())])

    def place(batches):
        slot, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(2).to_numpy(zero_copy_only=False)
            before = at + np.cumsum(n) - n
            at = int(before[-1] + n[-1])
            yield batch_of(placed, np.full(len(n), slot), b.column(3), b.column(4), before, b.column(2))

    order = ["key", "doc_id", "part", "row"]
    along = encoded.select("key", "doc_id", "n", "part", "row").repartitionByRange(*order).sortWithinPartitions(*order)
    line = stored(along.mapInArrow(place, "slot int, part int, row long, local long, n long"), "pack-line")
    before = F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = line.groupBy("slot").agg(F.sum("n").alias("n")).select("slot", before.alias("base"))  # a row for each task
    at = line.join(bases, "slot").select("part", "row", (F.col("base") + F.col("local")).alias("at"))
    path = shared_dir(encoded.sparkSession, "pack-at")
    at.repartition("part").sortWithinPartitions("part", "row").write.partitionBy("part").parquet(path)
    discard(line)
    return path


def read_positions(path: str, part: int) -> np.ndarray:
    """The positions of a part's rows, by row."""
    files, root = filesystem(path)
    got = dataset.dataset(f"{root}/part={part}", filesystem=files, format="parquet").to_table(["row", "at"])
    out = np.zeros(got.num_rows, np.int64)
    out[got["row"].to_numpy()] = got["at"].to_numpy()
    return out
