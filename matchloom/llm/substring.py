"""Removal of passages that an earlier document has, by suffix automata of reference shards.

A window is ``window`` consecutive words.  A word goes if a window that covers it stands, word for word,
in a document of smaller id too.

Streaming every document past an automaton of every shard would cost documents times shards, so shards
are laid out such that a document meets only the shards that can match it, and are sent to the tasks by
a shuffle in place of a broadcast, as their volume grows with the corpus:

1.  Every window is assigned to its anchor, the smallest hash among its ``gram``-word grams.  Equal
    windows have equal anchors wherever they stand.  Neighbouring windows of one anchor make a segment.
2.  An anchor that occurs in one document only can't match.  The others' segments are told apart by a
    128-bit hash; segments that are equal throughout form a class, and in all documents but the
    smallest of its class the whole segment goes.
3.  The classes of an anchor are its reference shard.  In ascending order of document, each class is
    streamed past a suffix automaton of those before it; the matching statistics at or above ``window``
    give the spans, then the class joins the automaton.  A shard of over ``part`` classes is dealt into parts, and
    each two parts are a shard of their own, in a task of their own: any two classes meet in one of them.
4.  Parts of an anchor with over ``hot`` classes would cost more than its windows; its segments are cut into single
    windows, whose classes need no automaton.  This is exact as well.

Null texts count as empty (no words).  Repeats within a document don't count, nor do those between rows
of one doc_id.  A null doc_id is neither smaller nor larger: such rows lose nothing and remove nothing.
Repeated rows return a row each.  An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_and_text, slices, stored

WINDOW, GRAM, HOT, PART = 50, 8, 5000, 200

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_INVERSE = tuple(np.uint64(pow(int(c), -1, 1 << 64)) for c in _ODD)

ANCHORS = "doc_id long, tkey long, h long, c1 long, c2 long, s0 int, n int"
_ANCHORS = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("s0", pa.int32()), ("n", pa.int32())])


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space and tab to carriage return."""
    return text.encode().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Hashes of word ranges from prefix sums of h[i] * c**i, brought back to exponent zero."""
    return _mix((prefix[end] - prefix[start]) * back[start])


def segments(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, class hash 1, class hash 2, first word, number of words) of a document's segments."""
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        prefix, back = [], []
        for c, inverse in zip(_ODD, _INVERSE, strict=True):
            powers = np.full(n, c, np.uint64)
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
            unpowers = np.full(n, inverse, np.uint64)
            unpowers[0] = 1
            np.multiply.accumulate(unpowers, out=unpowers)
            prefix.append(np.concatenate([[np.uint64(0)], np.cumsum(_mix(hashes + c) * powers, dtype=np.uint64)]))
            back.append(unpowers)
        at = np.arange(n - gram + 1)
        low = _span_hashes(prefix[0], at, at + gram, back[0])
        width = window - gram + 1  # grams in a window
        span = 1
        while span * 2 <= width:  # minima of doubling width
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :]) if width > span else low
        new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        end = np.append(new[1:], len(low)) + window - 1
        return low[new], _span_hashes(prefix[0], new, end, back[0]), _span_hashes(prefix[1], new, end, back[1]), new, end - new


class SuffixAutomaton:
    """Suffix automaton over words, for several texts; a text may be streamed past it at any time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if w in nxt[last]:  # a text added before goes on the same way
                q = nxt[last][w]
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def spans(self, words, least: int) -> list[tuple[int, int]]:
        """Maximal word ranges covered by matches of at least ``least`` words."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        found: list[list[int]] = []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            if size >= least:
                if found and found[-1][1] >= i + 1 - size:
                    found[-1][1] = i + 1
                else:
                    found.append([i + 1 - size, i + 1])
        return [tuple(x) for x in found]


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The segments of all documents (doc_id, text, tkey); documents shorter than a window have none."""

    def run(batches):
        for b in slices(batches):
            for doc, text, tkey in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                if len(words) >= window and doc is not None:
                    h, c1, c2, s0, n = segments(words, window, gram)
                    cols = [np.full(len(h), doc), np.full(len(h), tkey), h.view(np.int64), c1.view(np.int64), c2.view(np.int64), s0.astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_ANCHORS)

    return docs.mapInArrow(run, ANCHORS)


def _single_windows(batches, window: int):
    """Each window of the given segments as a segment of its own; anchor and class are its own hashes."""
    for b in slices(batches):
        for doc, tkey, text, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = words_of(text)
            wanted = np.zeros(len(words), bool)
            for p in parts:
                wanted[p["s0"] : p["s0"] + p["n"] - window + 1] = True
            starts = np.flatnonzero(wanted)
            h1, h2 = (np.array([xxhash.xxh3_64_intdigest(b" ".join(words[s : s + window]), seed) for s in starts.tolist()], np.uint64).view(np.int64) for seed in (1, 2))
            k = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(k, doc), np.full(k, tkey), h1, h1, h2, starts.astype(np.int32), np.full(k, window, np.int32))], schema=_ANCHORS)


def removal_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, part: int = PART) -> DataFrame:
    """(doc_id, tkey, spans: word ranges to remove) of the documents (doc_id, text, tkey) that lose any."""
    every = stored(anchors(docs, window, gram), "substring-anchors")
    shared = every.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    rows = stored(every.join(shared, "h"), "substring-shared")

    def classes_of(table: DataFrame) -> DataFrame:
        return table.groupBy("h", "c1", "c2").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))

    classes = stored(classes_of(rows), "substring-classes")
    shards = stored(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "substring-shards")

    def with_text(parts: DataFrame) -> DataFrame:
        fields = [c for c in parts.columns if c not in ("doc_id", "tkey")]
        lists = parts.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct(*fields)).alias("parts"))
        return docs.join(lists, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "parts")

    # one occurrence of each class of a shard, in the smallest document that has it
    home = rows.join(classes.select("h", "c1", "c2", F.col("first").alias("doc_id")), ["h", "c1", "c2", "doc_id"]).join(shards, "h")
    home = home.groupBy("h", "c1", "c2", "doc_id", "n", "k").agg(F.min(F.struct("tkey", "s0")).alias("at"))
    home = stored(home.select("h", "c1", "c2", "doc_id", "at.tkey", "at.s0", "n", "k"), "substring-homes")
    cold, heated = home.where(F.col("k") <= hot), home.where(F.col("k") > hot).drop("k")
    n = F.ceil(F.col("k") / part)
    own = F.pmod(F.xxhash64("c1", "c2"), n)
    others = F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: j != own)
    cells = F.when(n == 1, F.array("h")).otherwise(F.transform(others, lambda j: F.xxhash64("h", F.least(j, own), F.greatest(j, own))))
    cold = cold.withColumn("cells", cells).drop("k")
    cut = pa.schema([("cell", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("words", pa.binary())])

    def cut_out(batches):
        for b in slices(batches):
            for doc, _, text, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                yield batch_of(cut, *zip(*((c, p["h"], doc, p["c1"], p["c2"], b" ".join(words[p["s0"] : p["s0"] + p["n"]])) for p in parts for c in p["cells"]), strict=True))

    spans = pa.schema([("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def stream(batches):
        shard, doc, waiting, machine, out = None, None, [], SuffixAutomaton(), []
        for b in batches:
            for cell, h, d, c1, c2, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cell != shard:
                    shard, doc, waiting, machine = cell, d, [], SuffixAutomaton()
                elif d != doc:
                    for text in waiting:
                        machine.add(text)
                    doc, waiting = d, []
                words = line.split()
                if found := machine.spans(words, window):
                    out.append((h, c1, c2, [{"a": x, "b": y} for x, y in found]))
                waiting.append(words)
            if out:
                yield batch_of(spans, *zip(*out, strict=True))
                out = []

    lines = with_text(cold).mapInArrow(cut_out, "cell long, h long, doc_id long, c1 long, c2 long, words binary")
    matched = lines.repartition("cell").sortWithinPartitions("cell", "doc_id").mapInArrow(stream, "h long, c1 long, c2 long, spans array<struct<a:int,b:int>>")
    matched = matched.groupBy("h", "c1", "c2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # stored, so that both sides of the next join are dealt anew and hot classes can be split
    facts = stored(classes.drop("n").join(matched, ["h", "c1", "c2"], "left"), "substring-facts")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    lost = rows.join(facts, ["h", "c1", "c2"]).select("doc_id", "tkey", "s0", F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("spans")).alias("spans"))
    lost = lost.where("spans is not null").select("doc_id", "tkey", F.transform("spans", lambda x: F.struct((x["a"] + F.col("s0")).alias("a"), (x["b"] + F.col("s0")).alias("b"))).alias("spans"))
    if heated.limit(1).count():
        single = with_text(heated).mapInArrow(lambda batches: _single_windows(batches, window), ANCHORS)
        single = stored(single, "substring-windows")
        first = stored(classes_of(single).select("h", "c1", "c2", "first"), "substring-firsts")
        again = single.join(first, ["h", "c1", "c2"]).where("doc_id > first")
        lost = lost.unionByName(again.select("doc_id", "tkey", F.array(F.struct(F.col("s0").alias("a"), (F.col("s0") + F.col("n")).alias("b"))).alias("spans")))
    return lost.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, part: int = PART, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept (the words
    that stay, joined by a space)."""
    base = id_and_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    lost = removal_spans(base, window, gram, hot, part)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *[("kept", pa.string())] * texts])

    def drop(batches):
        for b in slices(batches):
            rows = []
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                gone = 0
                kept = words
                if spans:
                    stay = np.ones(len(words), bool)
                    for s in spans:
                        stay[s["a"] : s["b"]] = False
                    kept = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
                    gone = len(words) - len(kept)
                line = b" ".join(kept)
                rows.append((doc, len(words), gone, hashlib.sha256(line).hexdigest(), *[line.decode()] * texts))
            if rows:
                yield batch_of(out, *zip(*rows, strict=True))

    both = base.join(lost, ["doc_id", "tkey"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
