"""Benchmark decontamination: suffix arrays over the training texts, searched for every benchmark suffix.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.  A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window.  A document word inside an
occurrence of a window is hit.

1.  Items are cut into pieces that overlap by ``window - 1`` words, so no piece exceeds ``PIECE_WORDS``, and dealt
    into blocks of about ``BLOCK_WORDS`` words in the shared folder.  Tasks read a block at a time: nothing of the
    benchmark passes through the driver, and a worker holds one block, whatever the benchmark's size.
2.  A task gathers its documents into shards of about ``SHARD_WORDS`` words (longer documents are cut with an overlap
    of a piece) and builds the suffix array of each by prefix doubling.  Words that no item of the block has break the
    text, and stretches without a break that are shorter than every window are left out: no match can stand there.
3.  Every suffix of the block is searched in the array by bisection, all of them at once.  The range of suffixes that
    start with a window's words has its occurrences; the neighbours of an item's suffix have its longest match.

Occurrences are marked by shard position, never as pairs, so a passage that many documents and items share costs no
more than its words.  Tasks keep nothing, so a lost one is run again.

Null and empty texts have no words; a null item_id hits words but isn't listed; items that repeat an id count once.
Repeated and null doc_ids return a row each.  An empty benchmark hits nothing.  Extra columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, filesystem, id_and_text, shared_dir, slices, stored

WINDOW = 10
#: Words of a piece of an item, of a block of pieces, and of a shard of documents.
PIECE_WORDS, BLOCK_WORDS, SHARD_WORDS = 1 << 12, 1 << 18, 1 << 20

# Bytes of words, lower-cased; all others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PIECE = pa.schema([("item_id", pa.string()), ("item_start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])
PIECES = "item_id string, item_start int, n int, words binary"
FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
LONGEST = "item_id string, n_words int, item_start int, doc_id long, doc_start int"
_LONGEST = pa.schema([("item_id", pa.string()), ("n_words", pa.int32()), ("item_start", pa.int32()), ("doc_id", pa.int64()), ("doc_start", pa.int32())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of non-zero ids, sorted by what starts there, as far as the next zero or ``depth`` ids.

    The last id is zero.  The first ids go into one number; then each round doubles the length that ranks stand for,
    and sorts the ties alone.
    """
    at = np.flatnonzero(ids)
    n = len(ids)
    if not len(at):
        return at
    bits = int(ids.max()).bit_length()
    known = max(1, 62 // bits)
    padded = np.concatenate([ids, np.zeros(known, ids.dtype)]).astype(np.int64)
    keys = np.zeros(len(at), np.int64)
    for j in range(known):
        keys = (keys << bits) | padded[at + j]
    ends = np.flatnonzero(ids == 0)
    run = np.zeros(n, np.int64)
    run[at] = ends[np.searchsorted(ends, at)] - at
    order = np.argsort(keys, kind="stable")
    out, keys = at[order], keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    rank = np.zeros(n + 1, np.int64)
    slots = np.arange(len(out))
    while True:
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        rank[out] = first[group] + 1
        if known >= depth:
            return out
        long = run[out] > known
        open_ = (np.bincount(group) > 1) & (np.bincount(group, long) > 0)
        tied = slots[open_[group]]
        if not len(tied):
            return out
        pos = out[tied]
        further = np.where(run[pos] > known, rank[np.minimum(pos + known, n)], 0)
        keys = rank[pos] * (n + 2) + further
        order = np.argsort(keys, kind="stable")
        out[tied], keys = pos[order], keys[order]
        new[tied] |= np.concatenate([[True], keys[1:] != keys[:-1]])
        known *= 2


def bisect(array: np.ndarray, ids: np.ndarray, pattern: np.ndarray, starts: np.ndarray, widths: np.ndarray, after: bool) -> np.ndarray:
    """For each pattern[start : start + width], the first place in the suffix array that isn't before it; with
    ``after`` the first one beyond all suffixes that begin with it."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    while (some := np.flatnonzero(low < high)).size:
        middle = (low[some] + high[some]) // 2
        pos = array[middle]
        right = np.full(len(some), after)  # where all of the pattern is equal
        open_ = np.arange(len(some))
        j = 0
        while open_.size:
            open_ = open_[widths[some[open_]] > j]
            have, want = ids[pos[open_] + j], pattern[starts[some[open_]] + j]
            right[open_[have < want]] = True
            right[open_[have > want]] = False
            open_ = open_[have == want]
            j += 1
        low[some[right]] = middle[right] + 1
        high[some[~right]] = middle[~right]
    return low


def common_words(pos: np.ndarray, ids: np.ndarray, pattern: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """How many ids are equal from each position and each pattern's start on; a negative position has none."""
    out = np.zeros(len(pos), np.int64)
    open_, j = np.flatnonzero(pos >= 0), 0
    while open_.size:
        open_ = open_[widths[open_] > j]
        open_ = open_[ids[pos[open_] + j] == pattern[starts[open_] + j]]
        j += 1
        out[open_] = j
    return out


class Block:
    """Pieces of items as ids of the block's own words, their distinct windows, and the items of each window."""

    def __init__(self, rows: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({r[0] for r in rows if r[0] is not None})
        index = {name: i for i, name in enumerate(self.names)}
        ids, item, start, of, left = [], [], [], [], []
        for name, item_start, n, joined in rows:
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in joined.split()] + [0]
            item += [index.get(name, -1)] * (n + 1)
            start += [*range(item_start, item_start + n + 1)]
            left += [*range(n, -1, -1)]
            of += [min(n, window)] * (n + 1)
        self.ids, self.item, self.start, self.left = (np.array(x, np.int64) for x in (ids, item, start, left))
        width = np.array(of, np.int64)
        self.longest = int(self.left.max(initial=0))
        places = np.flatnonzero((self.left >= width) & (width > 0))
        offsets = np.arange(window)
        padded = np.concatenate([self.ids, np.zeros(window, np.int64)])
        windows = np.where(offsets < width[places, None], padded[places[:, None] + offsets], 0)
        _, one, kind = np.unique(windows, axis=0, return_index=True, return_inverse=True)
        self.places, self.widths = places[one], width[places][one]
        self.least = int(self.widths.min(initial=window))
        listed = np.unique(np.stack([kind.ravel(), self.item[places]], 1)[self.item[places] >= 0], axis=0)
        self.of_window = np.searchsorted(listed[:, 0], np.arange(len(one) + 1))  # the items of window k: from k to k + 1
        self.items = listed[:, 1]

    def encode(self, words: list[bytes]) -> np.ndarray:
        """Ids of words; stretches of known words too short for any window count as unknown.  Room for any comparison
        follows the last."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        ends = np.flatnonzero(np.concatenate([[0], ids, [0]]) == 0)
        short = np.diff(ends) - 1 < self.least
        gone = np.repeat(short, np.diff(ends))[: len(ids)]
        ids[gone] = 0
        return np.concatenate([ids, np.zeros(self.longest + 1, np.int64)])


def read_blocks(path: str, blocks: int, window: int):
    """The blocks of a benchmark from the shared folder, one at a time; an only one is kept by the caller."""
    files, top = filesystem(path)
    for k in range(blocks):
        table = pq.read_table(f"{top}/block={k}", filesystem=files, columns=["item_id", "item_start", "n", "words"], partitioning=None)
        yield Block(list(zip(*(c.to_pylist() for c in table.columns), strict=True)), window)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) of all places from low to high of each."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]


class Shard:
    """Documents of a task that are searched together."""

    def __init__(self, longest: int, limit: int):
        self.longest, self.limit = longest, max(limit, 2 * longest)
        self.words: list[bytes] = []
        self.firsts, self.docs, self.offsets = [], [], []  # of each segment: first place, document, first word there
        self.sizes: list[int] = []

    def add(self, words: list[bytes]) -> None:
        n, step = len(words), self.limit - self.longest
        for offset in range(0, max(1, n - self.longest), step) if n > self.limit else (0,):
            self.firsts.append(len(self.words))
            self.docs.append(len(self.sizes))
            self.offsets.append(offset)
            self.words += words[offset : offset + self.limit]
            self.words.append(b"")
        self.sizes.append(n)

    def full(self) -> bool:
        return len(self.words) >= self.limit

    def hits(self, blocks) -> list[tuple[list, list]]:
        """(spans, item ids) of each document."""
        spans, items = [[] for _ in self.sizes], [set() for _ in self.sizes]
        firsts = np.array(self.firsts)
        for block in blocks:
            ids = block.encode(self.words)
            array = suffix_array(ids, int(block.widths.max(initial=1)))
            low = bisect(array, ids, block.ids, block.places, block.widths, False)
            high = bisect(array, ids, block.ids, block.places, block.widths, True)
            marks = np.zeros(len(ids) + 1, np.int32)
            seen = []
            for k in np.array_split(np.flatnonzero(high > low), max(1, int((high - low).sum()) >> 20)):
                which, place = _spread(low[k], high[k])
                pos = array[place]
                np.add.at(marks, pos, 1)
                np.add.at(marks, pos + block.widths[k][which], -1)
                seen.append(np.unique(np.stack([np.searchsorted(firsts, pos, "right") - 1, k[which]], 1), axis=0))
            edges = np.flatnonzero(np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=0, append=0))
            for start, end in edges.reshape(-1, 2).tolist():
                s = int(np.searchsorted(firsts, start, "right")) - 1
                shift = self.offsets[s] - self.firsts[s]
                spans[self.docs[s]].append((start + shift, end + shift))
            for s, k in np.concatenate(seen or [np.zeros((0, 2), int)]).tolist():
                items[self.docs[s]].update(block.items[block.of_window[k] : block.of_window[k + 1]].tolist() if len(blocks) == 1 else map(block.names.__getitem__, block.items[block.of_window[k] : block.of_window[k + 1]].tolist()))
            if len(blocks) == 1:
                items = [map(block.names.__getitem__, x) for x in items]
        return [(united(x), sorted(y)) for x, y in zip(spans, items, strict=True)]

    def longest_of_items(self, blocks, doc_ids: list) -> list[tuple]:
        """(item_id, words, first word of the item, doc_id, first word of the document) of each item's longest match here."""
        out = []
        for block in blocks:
            ids = block.encode(self.words)
            array = suffix_array(ids, block.longest + 1)
            starts = np.flatnonzero(block.left > 0)
            if not len(array):
                continue
            left = block.left[starts]
            at = bisect(array, ids, block.ids, starts, left, False)
            near = [np.where((p >= 0) & (p < len(array)), array[np.clip(p, 0, len(array) - 1)], -1) for p in (at - 1, at)]
            shared = np.stack([common_words(p, ids, block.ids, starts, left) for p in near])
            best = shared.max(0)
            for name, k in enumerate(block.names):
                own = np.flatnonzero(block.item[starts] == name)
                top = own[best[own] == best[own].max()][0]
                n = int(best[top])
                if n >= block.least:
                    # All suffixes with those words are locations; the first of the smallest doc_id stands for them.
                    low, high = (int(bisect(array, ids, block.ids, starts[top : top + 1], np.array([n]), x)[0]) for x in (False, True))
                    pos = array[low:high]
                    s = np.searchsorted(np.array(self.firsts), pos, "right") - 1
                    doc_id, doc_start = min(((doc_ids[self.docs[i]], int(p) - self.firsts[i] + self.offsets[i]) for i, p in zip(s.tolist(), pos.tolist(), strict=True)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
                    out.append((k, n, int(block.start[starts[top]]), doc_id, doc_start))
        return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, ascending; spans that touch become one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


class Benchmark:
    """A benchmark cut into pieces and dealt into blocks in the shared folder."""

    def __init__(self, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", piece_words: int = PIECE_WORDS, block_words: int = BLOCK_WORDS):
        if window < 1:
            raise ValueError("a window has one word or more")
        piece = max(piece_words, 2 * window)
        step = piece - window + 1

        def cut(batches):
            for batch in batches:
                for part in slices([batch]):
                    rows = []
                    for name, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        words = words_of(text)
                        for at in range(0, max(1, len(words) - window + 1), step) if words else ():
                            own = words[at : at + piece]
                            rows.append((name, at, len(own), b" ".join(own)))
                    if rows:
                        yield batch_of(_PIECE, *zip(*rows, strict=True))

        named = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
        pieces = stored(named.mapInArrow(cut, PIECES).distinct(), "benchmark-pieces")
        facts = pieces.agg(F.sum("n").alias("n"), F.max("n").alias("longest")).first()
        self.window, self.longest = window, facts.longest or 0
        self.blocks = -(-(facts.n or 0) // block_words)
        self.path = shared_dir(items.sparkSession, "benchmark")
        if self.blocks:
            dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "item_start", "words"), F.lit(self.blocks)).cast("int"))
            # A block that the hash left empty has no folder; numbers are made dense again.
            present = dealt.select("block").distinct().orderBy("block").collect() if self.blocks > 1 else [(0,)]
            dense = F.create_map(*(F.lit(int(x)) for i, (b,) in enumerate(present) for x in (b, i)))
            self.blocks = len(present)
            dealt.withColumn("block", F.element_at(dense, F.col("block"))).repartition(self.blocks, "block").write.partitionBy("block").parquet(self.path)

    def shards(self, batches, text_at: int, limit: int):
        """(batches, shard, blocks) of a task's batches, a shard at a time."""
        kept = list(read_blocks(self.path, 1, self.window)) if self.blocks == 1 else _Each(self) if self.blocks else []
        held, shard = [], Shard(self.longest, limit)
        for part in slices(batches):
            held.append(part)
            for text in part.column(text_at).to_pylist():
                shard.add(words_of(text))
            if shard.full():
                yield held, shard, kept
                held, shard = [], Shard(self.longest, limit)
        if held:
            yield held, shard, kept


class _Each:
    """The blocks, read anew each time they are gone through."""

    def __init__(self, benchmark: Benchmark):
        self.path, self.blocks, self.window = benchmark.path, benchmark.blocks, benchmark.window

    def __len__(self) -> int:
        return self.blocks

    def __iter__(self):
        return read_blocks(self.path, self.blocks, self.window)


def search(docs: DataFrame, benchmark: Benchmark, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (ids with a window in it, sorted as strings), spans (hit words)."""

    def find(batches):
        for held, shard, blocks in benchmark.shards(batches, 1, shard_words):
            found = shard.hits(blocks)
            ids = [x for b in held for x in b.column(0).to_pylist()]
            spans = [[{"start": s, "end": e} for s, e in own] for own, _ in found]
            yield batch_of(_FOUND, ids, shard.sizes, [sum(e - s for s, e in own) for own, _ in found], [items for _, items in found], spans)

    return id_and_text(docs, id_col, text_col).mapInArrow(find, FOUND)


def longest_matches(docs: DataFrame, benchmark: Benchmark, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Of each item the longest verbatim match in any document, and where: item_id, n_words, item_start, doc_id, doc_start.

    Matches shorter than the shortest window aren't listed; ties go to the smaller doc_id (null first), then place.
    Beyond ``PIECE_WORDS`` words a match is told as that of its longest piece.
    """

    def find(batches):
        for held, shard, blocks in benchmark.shards(batches, 1, shard_words):
            rows = shard.longest_of_items(blocks, [x for b in held for x in b.column(0).to_pylist()])
            if rows:
                yield batch_of(_LONGEST, *zip(*rows, strict=True))

    rows = id_and_text(docs, id_col, text_col).mapInArrow(find, LONGEST)
    first = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id"), F.col("doc_start"), F.col("item_start")))
    return rows.groupBy("item_id").agg(first.alias("m")).select("item_id", (-F.col("m.n")).alias("n_words"), "m.item_start", "m.doc_id", "m.doc_start")


def decontaminate(docs: DataFrame, benchmark: Benchmark, text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of documents without a hit word, all their columns as they are."""
    at = docs.columns.index(text_col)

    def clean(batches):
        for held, shard, blocks in benchmark.shards(batches, at, shard_words):
            keep = iter([not spans for spans, _ in shard.hits(blocks)])
            for b in held:
                yield b.filter(pa.array([next(keep) for _ in range(b.num_rows)]))

    return docs.mapInArrow(clean, docs.schema)


def items_text(items: str | Column = "items") -> Column:
    return F.array_join(items, ",")
