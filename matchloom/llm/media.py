"""Media columns: payloads as 8-bit images in archives, read back by a Spark data source.

A payload (UTF-8 bytes, padded with zeros to a positive multiple of 64) becomes a grey PNG image 64 samples
wide; a text chunk keeps its length without the padding, so the stored form depends on the text alone.
Images are members of plain tar archives, one archive per task, with an index of member offsets beside it.

The data source ``media_archive`` plans byte ranges over the archives of a folder without opening them,
finds the members whose headers begin in a range through the archive's index, and streams them as Arrow
batches of bounded size.  A member that fails, or whose checksums do, is read again by its own offset, on a new
handle, without touching the others; after ``retries`` failures it is an error (``onError=report``: a row with the error).

Null texts count as empty; repeated rows and ids are members of their own; null ids stay null; an empty
table gives no archives and no rows; extra columns are not read.
"""

from __future__ import annotations

import binascii
import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Published, batch_of, filesystem, id_and_text, shared_dir, slices, stored

WIDTH = 64
_STEP = 1 << 14  # image rows deflated at a time
_SIGN = b"\x89PNG\r\n\x1a\n"
_INDEX = np.dtype([("at", "<i8"), ("size", "<i8"), ("doc_id", "<i8"), ("null", "u1")])

MANIFEST = "archive string, members long, n_bytes long"
SCHEMA = "archive string, member string, at long, doc_id long, media binary, attempts int, error string"


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the width."""
    return payload + bytes(WIDTH * max(1, -(-len(payload) // WIDTH)) - len(payload))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(data, binascii.crc32(kind)))


def encode_image(payload: bytes, level: int = 1) -> bytes:
    """A grey 8-bit PNG of the padded payload."""
    padded = pad(payload)
    height = len(padded) // WIDTH
    parts = [_SIGN, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)), _chunk(b"tEXt", b"Bytes\0%d" % len(payload))]
    deflate = zlib.compressobj(level)
    for r in range(0, height, _STEP):
        rows = np.frombuffer(padded[r * WIDTH : (r + _STEP) * WIDTH], np.uint8).reshape(-1, WIDTH)
        lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each line
        lines[:, 1:] = rows
        if data := deflate.compress(lines.tobytes()):
            parts.append(_chunk(b"IDAT", data))
    return b"".join([*parts, _chunk(b"IDAT", deflate.flush()), _chunk(b"IEND", b"")])


def chunks(image: bytes):
    """(kind, body) of a PNG image's chunks; every checksum is verified, up to the end chunk."""
    if image[:8] != _SIGN:
        raise ValueError("not a PNG image")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(image):
            raise ValueError("the image is cut off")
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if struct.pack(">I", binascii.crc32(body, binascii.crc32(kind))) != image[at + 8 + size : at + 12 + size]:
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, body
        at += 12 + size


def decode_image(image: bytes) -> tuple[bytes, int]:
    """The samples and the length without padding; every chunk's checksum is verified."""
    data, n = [], None
    for kind, body in chunks(image):
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not an 8-bit grey image")
        elif kind == b"tEXt" and body.startswith(b"Bytes\0"):
            n = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are written here")
    return np.ascontiguousarray(lines[:, 1:]).tobytes(), width * height if n is None else n


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 16-bit sign of how quarters of the value range
    are filled along the image: a text of fixed form that depends on the samples alone."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, values = len(x), np.arange(256)
    total, square = int((counts * values).sum()), int((counts * values * values).sum())
    mean = total / n
    spread = math.sqrt(max(0, square * n - total * total)) / n
    entropy = -sum(c / n * math.log2(c / n) for c in counts.tolist() if c)
    bands = np.add.reduceat(x.astype(np.int64), np.linspace(0, n, 17).astype(int)[:-1])
    widths = np.diff(np.linspace(0, n, 17).astype(int))
    sign = sum(1 << i for i, (s, w) in enumerate(zip(bands.tolist(), widths.tolist(), strict=True)) if s * n > total * w)
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};bands={sign:04x}"


def _tar_header(name: bytes, size: int) -> bytes:
    head = bytearray(512)
    head[: len(name)] = name
    head[100:108], head[108:116], head[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    head[124:136] = b"%011o\0" % size if size < 8 << 30 else b"\x80" + size.to_bytes(11, "big")
    head[136:148], head[148:156], head[156:157], head[257:265] = b"00000000000\0", b" " * 8, b"0", b"ustar\x0000"
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def write_archives(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> tuple[str, DataFrame]:
    """Write the texts of a table as images in archives below ``path``; (path, manifest).  No shuffle."""
    path = path or shared_dir(docs.sparkSession, "media")
    schema = pa.schema([("archive", pa.string()), ("members", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches):
        part, out, index = TaskContext.get().partitionId(), None, []
        name = f"{path}/part-{part:06d}.tar"
        for b in slices(batches):
            out = out or Published(name)
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                image = encode_image(text.encode(), level)
                at = out.size
                out.write(_tar_header(b"%s-%d.png" % (b"null" if doc is None else str(doc).encode(), len(index)), len(image)))
                out.write(image + bytes(-len(image) % 512))
                index.append((at, len(image), doc or 0, doc is None))
        if out is not None:
            out.write(bytes(1024))
            side = Published(f"{name}.idx")
            side.write(np.array(index, _INDEX).tobytes())
            side.publish()
            out.publish()
            yield batch_of(schema, [name], [len(index)], [out.size])

    return path, stored(id_and_text(docs, id_col, text_col).mapInArrow(write, MANIFEST), "media-manifest")


class _Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", 32 << 20))
        self.batch = int(options.get("batchBytes", 8 << 20))
        self.retries = int(options.get("retries", 3))
        self.report = options.get("onError", "fail") == "report"

    def partitions(self):
        files, path = filesystem(self.path)
        there = files.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        whole = sorted((f.path, f.size) for f in there if f.path.endswith(".tar"))
        return [_Range(name, s, min(s + self.split, size)) for name, size in whole for s in range(0, size, self.split)] or [_Range("", 0, 0)]

    def open(self, files, name: str):
        return files.open_input_file(name)

    def read(self, partition):
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("at", pa.int64()), ("doc_id", pa.int64()), ("media", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])
        if not partition.archive:
            return
        files, _ = filesystem(self.path)
        with files.open_input_file(f"{partition.archive}.idx") as f:
            index = np.frombuffer(f.read(), _INDEX)
        mine = index[np.searchsorted(index["at"], partition.start) : np.searchsorted(index["at"], partition.end)]
        handle, rows, held = None, [], 0
        try:
            for m in mine:
                at, size, error = int(m["at"]), int(m["size"]), None
                member, media = None, None
                for attempt in range(1, self.retries + 1):
                    try:
                        handle = handle or self.open(files, partition.archive)
                        handle.seek(at)
                        head = handle.read(512)
                        data = handle.read(size)
                        if head[257:262] != b"ustar" or len(data) != size:
                            raise OSError("no whole member at this offset")
                        if head[148:156] != b"%06o\0 " % sum(head[:148] + b" " * 8 + head[156:]):
                            raise OSError("the member's header is damaged")
                        for _ in chunks(data):  # a torn payload fails here, where it can be read again
                            pass
                        member, media, error = head[:100].rstrip(b"\0").decode(), data, None
                        break
                    except (OSError, ValueError) as e:
                        error = f"{type(e).__name__}: {e}"
                        if handle is not None:
                            handle.close()
                        handle = None
                if error and not self.report:
                    raise OSError(f"{partition.archive} at {at}: {error}")
                rows.append((partition.archive, member, at, None if m["null"] else int(m["doc_id"]), media, attempt, error))
                held += size
                if held >= self.batch:
                    yield batch_of(schema, *zip(*rows, strict=True))
                    rows, held = [], 0
        finally:
            if handle is not None:
                handle.close()
        if rows:
            yield batch_of(schema, *zip(*rows, strict=True))


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options splitBytes, batchBytes, retries, onError."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MediaArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of
    each stored image of a table (doc_id, media)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for doc, image in zip(*(c.to_pylist() for c in b.columns), strict=True):
                samples, n = decode_image(image)
                rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            if rows:
                yield batch_of(schema, *zip(*rows, strict=True))

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
