"""Token-id files by bit-plane shuffling.

A file holds the ids of many documents in order.  Ids go in blocks of a fixed size; each block is
transposed into byte planes (or bit planes), each plane is compressed with zstandard, and a chunk
index at the end gives every block's offset, plane sizes and checksum, so that any id range is read
by decoding the blocks that hold it and nothing else.

    "MLP1" | block 0 planes | block 1 planes | ... | documents | index | trailer

Null texts count as empty; an empty text has the end id alone; repeated doc_ids keep a row each, side
by side; null doc_ids sort first; an empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Published, a_task_each, batch_of, filesystem, id_and_text, shared_dir, slices, stored

MAGIC = b"MLP1"
BLOCK_IDS = 1 << 16
_TRAILER = struct.Struct("<QQQQ4s")  # places and sizes of the document table and the index

MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


def planes_of(ids: np.ndarray, plane: str) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if plane == "byte":
        return [row.tobytes() for row in octets]
    return [np.packbits((octets[b // 8] >> (b % 8)) & 1).tobytes() for b in range(32)]


def ids_of(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    """The inverse of planes_of."""
    if plane == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    octets = np.zeros((4, n), np.uint8)
    for b, p in enumerate(planes):
        octets[b // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (b % 8)
    return np.ascontiguousarray(octets.T).view("<u4").ravel()


class PlaneWriter:
    """Appends documents' ids to a binary stream that has write(bytes)."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, plane: str = "byte", level: int = 1):
        if plane not in ("byte", "bit"):
            raise ValueError("plane is byte or bit")
        self.out, self.block_ids, self.plane = out, block_ids, plane
        self.codec = zstandard.ZstdCompressor(level=level)
        self.at, self.waiting, self.held = 0, [], 0
        self.index: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def append(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._blocks(self.held - self.held % self.block_ids)

    def _blocks(self, upto: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        for s in range(0, upto, self.block_ids):
            block = ids[s : min(s + self.block_ids, upto)].astype("<u4")
            packed = [self.codec.compress(p) for p in planes_of(block, self.plane)]
            self.index.append([self.at, len(block), zlib.crc32(block.tobytes()), *map(len, packed)])
            self._put(b"".join(packed))
        self.waiting, self.held = [ids[upto:]], len(ids) - upto

    def finish(self) -> int:
        """Write the rest, the document table and the index; the number of ids."""
        self._blocks(self.held)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        docs = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes() + null.tobytes()
        places = []
        head = {"plane": self.plane, "block_ids": self.block_ids, "n_docs": len(self.doc_ids), "n_blocks": len(self.index)}
        for data in (docs, json.dumps(head).encode() + b"\n" + np.array(self.index, "<i8").tobytes()):
            packed = self.codec.compress(data)
            places += [self.at, len(packed)]
            self._put(packed)
        self._put(_TRAILER.pack(*places, MAGIC))
        return int(sum(self.lengths))


class PlaneReader:
    """Reads a file made by PlaneWriter through a random-access stream (seek, read, size)."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - _TRAILER.size)
        d_at, d_n, i_at, i_n, magic = _TRAILER.unpack(source.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a complete token file")
        self.codec = zstandard.ZstdDecompressor()
        head, _, raw = self._unpack(i_at, i_n).partition(b"\n")
        self.head = json.loads(head)
        self.plane, self.block_ids, n = self.head["plane"], self.head["block_ids"], self.head["n_docs"]
        self.index = np.frombuffer(raw, "<i8").reshape(self.head["n_blocks"], -1)
        docs = self._unpack(d_at, d_n)
        self.doc_ids, self.lengths, self.null = np.frombuffer(docs[: 8 * n], "<i8"), np.frombuffer(docs[8 * n : 16 * n], "<i8"), np.frombuffer(docs[16 * n :], np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def _unpack(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.codec.decompress(self.source.read(int(n)))

    def block(self, k: int) -> np.ndarray:
        at, n, crc, *sizes = self.index[k].tolist()
        self.source.seek(at)
        planes = [self.codec.decompress(self.source.read(size)) for size in sizes]
        ids = ids_of(planes, n, self.plane)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def pieces(self, start: int, length: int):
        """The ids of a range, block by block."""
        while length > 0:
            k, off = divmod(start, self.block_ids)
            got = self.block(k)[off : off + length]
            yield got
            start, length = start + len(got), length - len(got)

    def documents(self):
        """(doc_id or None, start, pieces of ids) of every document, decoding each block once."""
        k, ids = -1, None
        for d, (doc, null) in enumerate(zip(self.doc_ids.tolist(), self.null.tolist(), strict=True)):
            at, end, got = int(self.starts[d]), int(self.starts[d + 1]), []

            def parts(at=at, end=end):
                nonlocal k, ids
                while at < end:
                    if at // self.block_ids != k:
                        k = at // self.block_ids
                        ids = self.block(k)
                    off = at % self.block_ids
                    piece = ids[off : off + end - at]
                    at += len(piece)
                    yield piece

            got = parts()
            yield None if null else doc, at, got


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, plane: str = "byte") -> DataFrame:
    """Tokenise whole texts and write them in ascending id order, one file per range of ids.

    Returns the manifest (one row per file), stored.  The texts are dealt by range of the id and, where many
    texts share an id (or have none), by their hash, so a file holds a run of ids and memory holds one block
    and a file's document table.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or tokens.default_path()
    path = path or shared_dir(spark, "tokens")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches):
        part, out = TaskContext.get().partitionId(), None
        name = f"{path}/part-{part:06d}.mlp"
        for b in slices(batches):
            if out is None:
                out = Published(name)
                writer = PlaneWriter(out, block_ids, plane)
            enc = tokens.encoder(tokenizer)
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                writer.append(doc, np.frombuffer(ids, enc.dtype))
        if out is not None:
            n = writer.finish()
            out.publish()
            yield batch_of(schema, [part], [name], [len(writer.doc_ids)], [n], [out.size])

    order = ["doc_id", F.xxhash64("text")]
    dealt = id_and_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers).  A task for about each file; the manifest has a row per file and stays a table."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "path", before.alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for _, path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    reader, rows = PlaneReader(f), []
                    for d, (doc, at, parts) in enumerate(reader.documents()):
                        crc = 0
                        for ids in parts:
                            crc = zlib.crc32(ids, crc)
                        rows.append((doc, base + at, int(reader.lengths[d]), crc))
                        if len(rows) == 4096:
                            yield batch_of(schema, *zip(*rows, strict=True))
                            rows = []
                    if rows:
                        yield batch_of(schema, *zip(*rows, strict=True))

    return a_task_each(files).mapInArrow(read, READ_BACK)


def read_ids(path: str, doc_index: int) -> np.ndarray:
    """The ids of one document of a file, by its place, through the chunk index."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        reader = PlaneReader(f)
        return np.concatenate([np.zeros(0, "<u4"), *reader.pieces(int(reader.starts[doc_index]), int(reader.lengths[doc_index]))])
