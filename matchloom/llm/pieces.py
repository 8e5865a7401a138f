"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut where no piece can reach across (before a space that follows another character, and at
characters in no piece), and each distinct segment is encoded once per worker.  Hashes of all substrings of
a length probe the sorted hashes of the pieces.  Segments of equal length, or of a narrow band of lengths where
they are long, then advance together, end position by end position: the maximum over the pieces that end there,
taken for all segments at once, stores a backpointer.  Segments of any length go this way.

For a unigram model the score of a path is the sum of its pieces' scores.  A BPE model's scores are merge
ranks, and the path of the largest sum isn't what its merges give.  There the lattice is walked with
another score: an edge counts as 0 if its piece may follow the piece that ends where it begins, else
minus infinity.  Two pieces may be neighbours if merging their joined letters gives just the two; a
sequence is the merge result if and only if all neighbours may be, so for each end exactly one edge
survives and the walk gives the library's own ids (tests compare both model types with the library).

Null texts count as empty and have no ids.  The sign U+2581 in a text counts as a space, as in the library.
Repeated rows return a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, id_and_text, slices

#: Segments, and characters of them, that a worker keeps.
CACHE_SEGMENTS, CACHE_BYTES = 200_000, 16 << 20
#: Segments, and characters of them, that advance together; one at least.
BATCH_ROWS, BATCH_CHARS = 8192, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNKNOWN = 1 << 30  # ids from here on: a character without a piece


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PairTable:
    """Open-addressing table of neighbour pairs: whether two pieces may stand side by side."""

    def __init__(self, decide):
        self.decide = decide
        self._grow(1 << 16)

    def _grow(self, size: int, keys=(), values=()) -> None:
        self.size, self.count = size, 0
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, bool)
        self._insert(np.asarray(keys, np.int64), np.asarray(values, bool))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _BASE) >> np.uint64(20)).astype(np.int64) & (self.size - 1)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * (self.count + len(keys)) > self.size:
            used = self.keys >= 0
            old = self.keys[used], self.values[used]
            self._grow(4 * self.size, *old)
        for key, at, value in zip(keys.tolist(), self._slot(keys).tolist(), values.tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & (self.size - 1)
            self.keys[at], self.values[at] = key, value
        self.count += len(keys)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._slot(keys)
        out, todo = np.zeros(len(keys), bool), np.arange(len(keys))
        missing = []
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            missing.append(todo[there < 0])
            todo = todo[~hit & (there >= 0)]
            at[todo] = (at[todo] + 1) & (self.size - 1)
        return out, np.concatenate(missing) if missing else todo

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, missing = self._find(keys)
        if len(missing):
            new = np.unique(keys[missing])
            self._insert(new, np.array([self.decide(k) for k in new.tolist()], bool))
            out[missing] = self._find(keys[missing])[0]
        return out


class PieceEncoder:
    """Encoder and decoder of a SentencePiece model file whose normalisation is the identity."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("expected identity normalisation, kept spaces and byte fallback")
        self.prefix = spec.add_dummy_prefix
        self.merges = model.trainer_spec.model_type == 2
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.text_of: dict[int, str] = {}
        self.score = np.zeros(len(model.pieces))
        for i, p in enumerate(model.pieces):
            self.score[i] = p.score
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (1, 4):
                self.text_of[i] = p.piece.replace("▁", " ")
                self.bytes_of.append(self.text_of[i].encode())
            else:
                self.bytes_of.append(b"" if p.type == 3 else " ⁇ ".encode())
        self.id_of = {t: i for i, t in self.text_of.items()}
        self.unknown_score = float(self.score[list(self.text_of)].min()) - 10
        self.longest = max(map(len, self.id_of))
        usable = [t for t in self.id_of if not self.merges or self.merged(t) == [self.id_of[t]]]
        self.usable = set(usable)
        inner = [t for t in usable if " " in t.lstrip(" ")]
        if inner or any("\n" in t for t in usable):
            raise ValueError("a piece reaches across a space or a line end")
        keys = np.array([self._hash(t) for t in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([self.id_of[t] for t in usable], np.int64)[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.pairs = PairTable(self._neighbours)
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.dtype = np.dtype("<u2") if len(model.pieces) < 1 << 16 else np.dtype("<u4")

    @staticmethod
    def _finish(h, length):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) * (np.uint64(2 * length + 1) * np.uint64(0x94D049BB133111EB))

    def _hash(self, text: str) -> int:
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for c in text:
                h = h * _BASE + np.uint64(ord(c) + 1)
            return self._finish(h, len(text))

    def merged(self, text: str) -> list[int]:
        """Ids of a short text by merging best pairs first, the leftmost of equals; for neighbour tests."""
        parts = [*text]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.id_of.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of.get(p, _UNKNOWN + ord(p[0])) for p in parts]

    def _neighbours(self, key: int) -> bool:
        a, b = key >> 24, key & 0xFFFFFF
        return self.merged(self.text_of[a] + self.text_of[b]) == [a, b]

    def _may_follow(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether pieces may follow the last ones (-1: the start; unknown characters border on anything)."""
        out = np.ones(len(piece), bool)
        ask = np.flatnonzero((last >= 0) & (last < _UNKNOWN))
        if len(ask):
            out[ask] = self.pairs((last[ask] << 24) | piece[ask])
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first edge of each end, then rows, lengths and pieces of all edges by end): the pieces that stand in rows of
        character codes, found by the hashes of all substrings of one length at a time."""
        m, n = codes.shape
        ends, rows, sizes, pieces = [], [], [], []
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            # with exponents from the far end, prefix sums need no loop; each difference is brought back by its end
            prefix = np.zeros((n + 1, m), np.uint64)
            np.cumsum((codes.T + np.uint64(1)) * power[n - 1 :: -1][:n, None], axis=0, out=prefix[1:])
            inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
            for length in range(1, min(n, self.longest) + 1):
                h = self._finish((prefix[length:] - prefix[:-length]) * inverse[n - np.arange(length, n + 1)][:, None], length)
                end, row = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
                h = h[end, row]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                ends.append(end[hit] + length)
                rows.append(row[hit])
                sizes.append(np.full(int(hit.sum()), length))
                pieces.append(self.ids[at[hit]])
        end, row, size, piece = map(np.concatenate, (ends, rows, sizes, pieces))
        order = np.argsort(end, kind="stable")
        return np.searchsorted(end[order], np.arange(n + 2)), row[order], size[order], piece[order]

    def walk(self, segments: list[str]) -> list[bytes]:
        """Id buffers of segments, which advance together, end by end; shorter ones are filled up and stop at their own end."""
        m, sizes = len(segments), np.fromiter(map(len, segments), np.int64, len(segments))
        n = int(sizes.max())
        codes = np.frombuffer("".join(x.ljust(n, "\0") for x in segments).encode("utf-32-le"), "<u4").reshape(m, n).astype(np.uint64)
        first, row, size, piece = self.edges(codes)
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        last = np.full((n + 1, m), -1, np.int64)
        back = np.zeros((n + 1, m), np.int16)
        for j in range(1, n + 1):
            some = slice(first[j], first[j + 1])
            r, length, p = row[some], size[some], piece[some]
            single = np.zeros(m, bool)
            single[r[length == 1]] = True
            if self.merges:
                ok = self._may_follow(last[j - length, r], p) & np.isfinite(best[j - length, r])
                score = np.where(ok, 0.0, -np.inf)
            else:
                score = best[j - length, r] + self.score[p]
            order = np.lexsort((-length, score, r))  # of a row's edges, the best, and of equal ones the shortest
            order = order[np.append(r[order][1:] != r[order][:-1], True)] if len(order) else order
            order = order[np.isfinite(score[order])]
            best[j, r[order]], last[j, r[order]], back[j, r[order]] = score[order], p[order], length[order]
            lone = np.flatnonzero(~single)  # a character without a piece of its own
            score = best[j - 1, lone] + (0.0 if self.merges else self.unknown_score)
            up = lone[score > best[j, lone]]
            best[j, up] = best[j - 1, up] + (0.0 if self.merges else self.unknown_score)
            last[j, up], back[j, up] = _UNKNOWN + codes[up, j - 1].astype(np.int64), 1
        # backpointers give each segment's pieces from its end; a stable sort by segment turns them round
        at, live = sizes.copy(), np.arange(m)
        rows, ids = [], []
        while len(live):
            rows.append(live)
            ids.append(last[at[live], live])
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        rows, ids = np.concatenate(rows[::-1]), np.concatenate(ids[::-1])
        ids = ids[np.argsort(rows, kind="stable")]
        ends = np.cumsum(np.bincount(rows, minlength=m))
        if (ids >= _UNKNOWN).any():
            return [self._raw(x.tolist()) for x in np.split(ids, ends[:-1])]
        raw, ends = ids.astype(self.dtype).tobytes(), (ends * self.dtype.itemsize).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _raw(self, ids: list[int]) -> bytes:
        if max(ids) >= _UNKNOWN:
            ids = [y for x in ids for y in ([x] if x < _UNKNOWN else (self.byte_id[b] for b in chr(x - _UNKNOWN).encode("utf-8", "replace")))]
        return np.array(ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian id buffers of texts."""
        if len(self.known) > CACHE_SEGMENTS or self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        cut = re.compile(r"\n| *[^ \n]+| +").findall
        lines = [cut((" " if self.prefix and t else "") + t.replace("▁", " ")) for t in texts]
        known = self.known
        new = sorted({w for line in lines for w in line if w not in known}, key=len)
        self.held += sum(map(len, new))
        at = 0
        while at < len(new):
            # a band of lengths: the longest has at most a sixteenth more than the shortest
            upto = at + bisect.bisect_right(new[at : at + BATCH_ROWS], len(new[at]) * 17 // 16, key=len)
            upto = max(at + 1, min(upto, at + BATCH_CHARS // len(new[upto - 1])))
            some = new[at:upto]
            known.update(zip(some, self.walk(some), strict=True))
            at = upto
        get = known.__getitem__
        return [b"".join(map(get, line)) for line in lines]

    def decode(self, ids: bytes) -> str:
        """The text of an id buffer."""
        line = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, self.dtype).tolist())).decode("utf-8", "replace")
        return line[1:] if self.prefix and line.startswith(" ") else line


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's own encoder of a model file."""
    claim("pieces", _ENCODERS.clear)
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = PieceEncoder(f.read())
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids: little-endian buffer) of every whole text."""
    model = model or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc = encoder(model)
        for b in slices(batches, 2048, 8 << 20):
            ids = enc.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, ids binary")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids, text) of a table (doc_id, n_pieces, ids)."""
    model = model or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches):
        enc = encoder(model)
        for b in slices(batches, 2048, 8 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([enc.decode(x) for x in b.column(2).to_pylist()], pa.string())], schema=schema)

    return encoded.select("doc_id", "n_pieces", "ids").mapInArrow(run, "doc_id long, n_pieces long, ids binary, text string")
