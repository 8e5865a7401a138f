"""WARC archives as a chunked record table.

Writing: a record per page, each a gzip member of its own.  Of pages with equal payloads the one with the
largest id is a response record, the others are revisit records that name it.  Payloads are
encoded and deflated a slice at a time.

Reading: each archive is streamed; a payload leaves as rows (record, chunk number, data) of at most
``chunk_bytes``, and each row carries the number of bytes and the SHA-1 of the payload up to there.  So no
record is held whole, a record's digest is that of its last chunk, and chunks join back by number.  A payload
that doesn't match the digest in its header is an error.

Null payloads count as empty.  Empty payloads are equal to one another.  A null id is smaller than any
other, and pages whose ids are all null have nothing to refer to and are response records.  Rows that
repeat id and payload have a record each; those with the largest id are all responses.  An empty table gives
no archives and no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Published, a_task_each, batch_of, filesystem, shared_dir, slices, stored, whole_text

CHUNK_BYTES = 256 << 10
#: Groups of equal payloads of up to this many bytes are broadcast; beyond it they join by shuffle.
BROADCAST_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "part int, path string, records long, n_bytes long"
CHUNKS = "page_id long, record_type string, refers_to long, chunk int, last boolean, data binary, payload_bytes long, payload_digest string"
_CHUNKS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def sha1_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to) of pages; refers_to is null for response records."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), whole_text(url_col).alias("url"), whole_text(payload_col).alias("payload"))
    base = base.withColumn("sha", F.sha2("payload", 256))
    groups = base.groupBy("sha").agg(F.max("page_id").alias("chief"), F.count("*").alias("n")).where("n > 1 and chief is not null").select("sha", "chief")
    groups = stored(groups, "warc-groups")
    if groups.count() * 96 <= BROADCAST_BYTES:
        groups = F.broadcast(groups)
    refers = F.when(F.col("page_id").eqNullSafe(F.col("chief")), None).otherwise(F.col("chief"))
    return base.join(groups, "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str | None = None, level: int = 1) -> DataFrame:
    """Write the rows of with_revisits() as archives, one per task; the manifest, stored.  No shuffle."""
    path = path or shared_dir(pages.sparkSession, "warc")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches):
        part, out, n = TaskContext.get().partitionId(), None, 0
        name = f"{path}/part-{part:06d}.warc.gz"
        for b in slices(batches):
            out = out or Published(name)
            for page, url, text, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = text.encode()
                digest = sha1_base32(hashlib.sha1(payload).digest())
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                revisit = refers is not None
                lines = [
                    "WARC/1.1",
                    f"WARC-Type: {'revisit' if revisit else 'response'}",
                    f"WARC-Record-ID: {record_uri(page)}",
                    "WARC-Date: 1970-01-01T00:00:00Z",
                    f"WARC-Target-URI: {''.join(url.split())}",
                    f"WARC-Payload-Digest: sha1:{digest}",
                    f"WARC-Full-Payload-Length: {len(payload)}",
                    *([f"WARC-Refers-To: {record_uri(refers)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
                    "Content-Type: application/http; msgtype=response",
                    f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
                    "\r\n",
                ]
                deflate = zlib.compressobj(level, wbits=31)
                out.write(deflate.compress("\r\n".join(lines).encode() + http))
                for s in range(0, 0 if revisit else len(payload), CHUNK_BYTES):
                    out.write(deflate.compress(payload[s : s + CHUNK_BYTES]))
                out.write(deflate.compress(b"\r\n\r\n") + deflate.flush())
                n += 1
        if out is not None:
            out.publish()
            yield batch_of(schema, [part], [name], [n], [out.size])

    return stored(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, MANIFEST), "warc-manifest")


class _Inflated:
    """Reads a file of gzip members as one stream of bytes, a bounded piece at a time."""

    def __init__(self, source, piece: int = 64 << 10):
        self.source, self.piece = source, piece
        self.inflate, self.raw, self.ready = None, b"", bytearray()

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(self.piece)
            if not self.raw:
                if self.inflate is not None:
                    raise ValueError("the archive breaks off within a member")
                return False
        if self.inflate is None:
            self.inflate = zlib.decompressobj(wbits=31)
        self.ready += self.inflate.decompress(self.raw, self.piece)
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
        else:
            self.raw = self.inflate.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        """A line without its end; None at the end of the stream."""
        at = 0
        while (end := self.ready.find(b"\r\n", at)) < 0:
            at = max(0, len(self.ready) - 1)
            if not self._more():
                if self.ready:
                    raise ValueError("the archive breaks off within a line")
                return None
        out = bytes(self.ready[:end])
        del self.ready[: end + 2]
        return out

    def bytes(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the stream ends."""
        while not self.ready and self._more():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def records(source, chunk_bytes: int):
    """Chunk rows of an archive, in order."""
    stream = _Inflated(source)

    def fields() -> dict[str, str]:
        out = {}
        while line := stream.line():
            key, _, value = line.decode().partition(":")
            out[key.lower()] = value.strip()
        return out

    while (start := stream.line()) is not None:
        if not start.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        head = fields()
        kind, left = head["warc-type"], int(head["content-length"])
        page, refers = page_of(head["warc-record-id"]), page_of(head.get("warc-refers-to", ""))
        promised = head["warc-payload-digest"].removeprefix("sha1:")
        http = 0
        while line := stream.line():
            http += len(line) + 2
        left -= http + 2
        if kind == "revisit":
            yield page, kind, refers, 0, True, b"", int(head["warc-full-payload-length"]), promised
        else:
            hashed, n, chunk, last = hashlib.sha1(), 0, 0, False
            while not last:
                parts, size = [], 0
                while size < min(chunk_bytes, left):
                    if not (got := stream.bytes(min(chunk_bytes, left) - size)):
                        raise ValueError("the archive breaks off within a payload")
                    hashed.update(got)
                    parts.append(got)
                    size += len(got)
                left -= size
                n += size
                last = not left
                digest = sha1_base32(hashed.copy().digest())
                if last and digest != promised:
                    raise ValueError(f"record {page}: the payload doesn't match its digest")
                yield page, kind, None, chunk, last, b"".join(parts), n, digest
                chunk += 1
        if stream.line() or stream.line():
            raise ValueError("a record doesn't end with two empty lines")


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, batch_bytes: int = 4 << 20) -> DataFrame:
    """The chunk table of the archives of a manifest, a task for about each archive: page_id, record_type, refers_to,
    chunk, last, data, payload_bytes and payload_digest (both up to and with this chunk; of a revisit, the
    full payload's)."""

    def read(batches):
        for b in batches:
            for path in b.column(1).to_pylist():
                files, name = filesystem(path)
                with files.open_input_stream(name, compression=None) as f:
                    rows, held = [], 0
                    for row in records(f, chunk_bytes):
                        rows.append(row)
                        held += len(row[5]) + 256
                        if held >= batch_bytes:
                            yield batch_of(_CHUNKS, *zip(*rows, strict=True))
                            rows, held = [], 0
                    if rows:
                        yield batch_of(_CHUNKS, *zip(*rows, strict=True))

    return a_task_each(manifest.select("part", "path")).mapInArrow(read, CHUNKS)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
