"""SimHash near-deduplication by pigeonhole blocks.

Words are runs of characters other than white space (space, and tab to carriage return), A-Z lower-cased; a
shingle is ``shingle`` words joined by a space, and XXH64 (seed 42) of its UTF-8 is its hash.  A bit of
the 64-bit fingerprint is 1 if it is set in over half the hashes, repeats included.

A fingerprint is cut into ``distance + spare`` blocks.  Two fingerprints that differ in at most
``distance`` bits agree in at least ``spare`` whole blocks, so they share the key of some choice of
``spare`` blocks.  Distinct fingerprints are dealt by key and compared within runs of equal keys; with
2 bits and 4 spare blocks a key has at least 42 bits, so a run holds at most 2**22 distinct
fingerprints, however many documents there are.  Short runs are compared pairwise, long ones by probing
every fingerprint that differs in the bits outside the key, so cost is linear in the run; only a
spanning forest of a run's links leaves the task.

Null texts count as empty.  A text of fewer words than a shingle is one shingle; a text without words
has fingerprint zero and links like any other.  Equal fingerprints always link; repeated rows return a
row each.  A null doc_id is larger than any other when the smallest of a component is sought.  An empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, discard, id_and_text, slices, stored
from .components import connected_components

SHINGLE, DISTANCE, SPARE = 3, 2, 4
#: Runs up to this length are compared pairwise; longer ones by probing.  Both are exact.
PAIRWISE = 512

_HASH_CHUNK = 255 * 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _HASH_CHUNK):
        some = np.array([digest(line[a:b], 42) for a, b in zip(first[at : at + _HASH_CHUNK], last[at : at + _HASH_CHUNK], strict=True)], dtype=">u8")
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long: the fingerprint's 64 bits, tkey: XXH64 of the text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("tkey", pa.int64())])

    def run(batches):
        for b in slices(batches, 4096, 32 << 20):
            prints = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints), b.column(2)], schema=schema)

    return id_and_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, tkey long")


def block_masks(distance: int, spare: int) -> list[int]:
    """The 64-bit masks of all choices of ``spare`` blocks out of distance + spare."""
    n = distance + spare
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, spare)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _near_in_run(prints: np.ndarray, free: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a long run within the distance, found by flipping up to ``distance`` of the free bits."""
    order = np.argsort(prints)
    ranked = prints[order]
    bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    flips = [np.bitwise_xor.reduce(c) for d in range(1, distance + 1) for c in combinations(bits, d)]
    left, right = [], []
    for flip in flips:
        other = ranked ^ flip
        at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
        hit = np.flatnonzero((ranked[at] == other) & (other > ranked))
        left.append(order[hit])
        right.append(order[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def links_within(keys: DataFrame, masks: list[int], distance: int, pairwise: int = PAIRWISE) -> DataFrame:
    """Spanning links (a, b: rep) of a table (choice, key, rep, fp) of distinct fingerprints."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(choice, key, rep, fp):
        """Links within the whole runs of these sorted arrays."""
        n = len(key)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])]))
        size = np.diff(np.append(new, n))
        left, right = [], []
        for s, k in zip(new[size > pairwise].tolist(), size[size > pairwise].tolist(), strict=True):
            a, b = _near_in_run(fp[s : s + k], ~masks[choice[s]] & ((1 << 64) - 1), distance)
            left.append(a + s)
            right.append(b + s)
        to_end = np.repeat(new + size, size) - np.arange(n)  # members of the run from here on
        at = np.flatnonzero((to_end > 1) & (np.repeat(size, size) <= pairwise))
        gap = 1
        while len(at):
            hit = at[_popcount(fp[at] ^ fp[at + gap]) <= distance]
            left.append(hit)
            right.append(hit + gap)
            gap += 1
            at = at[to_end[at] > gap]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        root = _forest(n, a, b) if len(a) else np.arange(n)
        hung = np.flatnonzero(root != np.arange(n))
        return batch_of(schema, rep[hung], rep[root[hung]]) if len(hung) else None

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[3] = cols[3].astype(np.int64).view(np.uint64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0]  # the last run may go on
            held = [c[last:] for c in cols]
            if last and (out := solve(*(c[:last] for c in cols))) is not None:
                yield out
        if held is not None and len(held[0]) and (out := solve(*held)) is not None:
            yield out

    dealt = keys.select("choice", "key", "rep", "fp").repartition("choice", "key").sortWithinPartitions("choice", "key", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(prints: DataFrame, distance: int = DISTANCE, spare: int = SPARE, pairwise: int = PAIRWISE) -> DataFrame:
    """(fp, component) for each distinct fingerprint of a table (doc_id, fp)."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    masks = block_masks(distance, spare)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed))))
    # A fingerprint whose documents all have null ids links nothing: it has no id to be reached by.
    keys = distinct.where("rep is not null").select("rep", "fp", choices.alias("c")).select("c.choice", "c.key", "rep", "fp")
    found = connected_components(links_within(keys, masks, distance, pairwise))
    return distinct.join(found.select(F.col("u").alias("rep"), "v"), "rep", "left").select("fp", F.coalesce("v", "rep").alias("component"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, spare: int = SPARE) -> DataFrame:
    """One row per document: doc_id, fp, tkey, component_id (the smallest doc_id reachable over links)."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    found = simhash_components(prints, distance, spare)
    return prints.join(found, "fp", "left").select("doc_id", "fp", "tkey", F.col("component").alias("component_id"))


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


# ---------------------------------------------------------------------------------------------------
# Near copies at a Jaccard similarity, exactly.
#
# Keys: a prefix filter.  Put the shingles of all texts in one order.  Sets of n and more with a similarity s share at
# least ceil(s * n) shingles, so the first n - ceil(s * n) + 1 of each have one in common: those are a text's keys.
# Any order gives all pairs; shingles that are frequent in a sample come last, which makes runs of a key short.
#
# Families: texts that meet at a key are compared by sketches.  Bit i of a sketch is the parity of the hashes that fall
# on i, so two sketches differ in no more bits than the sets in shingles: no pair of the similarity is lost.  The
# components of the pairs that are left are the families, and all pairs of the similarity lie within one.
#
# Verification: whole sets meet once, in their family, and only links of the similarity leave it.

WIDE_SHINGLE = 5
#: Jaccard similarity of the shingle sets from which two texts are near copies.
SIMILARITY = 0.8
#: Runs of a key up to this length give their pairs; in longer ones the sketches meet.  Both are exact.
RUN_PAIRS = 16
#: Members of a run, and of a family, that meet in one task; larger ones are dealt into blocks.
RUN_BLOCK, FAMILY_BLOCK = 512, 128
#: About so many documents are asked which shingles are frequent: in at least so many of them, so many at most.  Only
#: the order of shingles depends on it, not the links.  Those in at least HOT of them are long runs without a count.
ORDER_DOCS, FREQUENT, MOST_FREQUENT, HOT = 16_000, 4, 1 << 16, 64
#: Tables of up to this size are broadcast to the texts; beyond it they join by shuffle.
BROADCAST_BYTES = 16 << 20

PRINTS = "doc_id long, n int, keys array<long>, sketch binary"


def shingle_hashes(text: str, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Distinct XXH64 hashes of a text's shingles; none for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(words))
    first, last = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def frequent_shingles(base: DataFrame, shingle: int) -> tuple[np.ndarray, int]:
    """Hashes of shingles that are frequent in a sample of a table (doc_id, text), rarer ones first, and how many of
    them, at the end, are hot."""
    schema = pa.schema([("key", pa.int64())])

    def run(batches):
        for b in slices(batches, 1024, 8 << 20):
            had = [shingle_hashes(t, shingle) for t in b.column(1).to_pylist()]
            yield batch_of(schema, np.concatenate(had).view(np.int64))

    share = max(1, base.count() // ORDER_DOCS)
    some = base.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(share)) == 0)
    often = some.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= FREQUENT)
    rows = often.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).collect()
    return np.array([r.key for r in reversed(rows)], np.int64).view(np.uint64), sum(r["count"] >= HOT for r in rows)


def prefix_keys(hashes: np.ndarray, similarity: float, frequent: np.ndarray, by_hash: np.ndarray) -> np.ndarray:
    """The keys of a set of sorted hashes, in order; ``by_hash`` sorts ``frequent``.  Sets without shingles meet at one key."""
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64)
    size = n - int(np.ceil(similarity * n - 1e-9)) + 1
    if not len(frequent):
        return hashes[:size]
    at = by_hash[np.minimum(np.searchsorted(frequent, hashes, sorter=by_hash), len(frequent) - 1)]
    late = frequent[at] == hashes
    return np.concatenate([hashes[~late], hashes[late][np.argsort(at[late])]])[:size]


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits, in a power of two of bits that is at least twice their number."""
    width = 64 << max(0, (max(1, 2 * len(hashes)) - 1).bit_length() - 6)
    return np.packbits((np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def sketch_difference(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the wider one folded: no more than the shingles that one of the sets has alone."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a)
    for bits in (4 * len(a) >> i for i in range((len(a) // len(b)).bit_length() - 1)):
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b)).bit_count()


def prints_of(base: DataFrame, shingle: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n: number of shingles, keys, sketch) of a table (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])
    by_hash = np.argsort(frequent)

    def run(batches):
        for b in slices(batches, 256, 8 << 20):
            sets = [shingle_hashes(t, shingle) for t in b.column(1).to_pylist()]
            keys = [prefix_keys(s, similarity, frequent, by_hash).view(np.int64) for s in sets]
            yield batch_of(schema, b.column(0), [len(s) for s in sets], keys, [parity_sketch(s) for s in sets])

    return base.select("doc_id", "text").mapInArrow(run, PRINTS)


def _runs(batches, columns: int, solve, limit: int | None = None, beyond=None):
    """What ``solve`` gives for whole runs of the first column; batches are sorted by it.  Of a run that is known to be
    longer than ``limit`` when a batch ends, the rows go to ``beyond`` as they come, so that no run is held whole."""
    held: list[list] = []
    leaving = None
    for b in batches:
        cols = [b.column(i) for i in range(columns)]
        key = cols[0].to_numpy(zero_copy_only=False)
        if leaving is not None:
            n = int(np.searchsorted(key, leaving, side="right"))
            if n:
                yield from beyond([c.slice(0, n) for c in cols])
            cols, key = [c.slice(n) for c in cols], key[n:]
            if not len(key):
                continue
            leaving = None
        first, last = (int(np.searchsorted(key, k)) for k in (key[0], key[-1]))
        if held and held[-1][0][0].as_py() != key[first]:
            yield from solve([pa.concat_arrays(x) for x in zip(*held, strict=True)])
            held = []
        if last:
            held.append([c.slice(0, last) for c in cols])
            yield from solve([pa.concat_arrays(x) for x in zip(*held, strict=True)])
            held = []
        held.append([c.slice(last) for c in cols])  # the last run may go on
        if limit is not None and sum(len(x[0]) for x in held) > limit:
            yield from beyond([pa.concat_arrays(x) for x in zip(*held, strict=True)])
            held, leaving = [], key[last]
    if held:
        yield from solve([pa.concat_arrays(x) for x in zip(*held, strict=True)])


def prefix_pairs(keys: DataFrame, similarity: float) -> DataFrame:
    """(key, a, b, na, nb) of a table (key, rep, n, at): the pairs of a short run whose sizes n allow the similarity; the
    members of a long run, each as an ``a`` without ``b``, with its place ``at`` among the text's keys as ``nb``."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32())])

    def members(cols):
        key, rep, n, place = cols
        yield batch_of(schema, key, rep, pa.nulls(len(key), pa.int64()), n, place)

    def solve(cols):
        key, rep, n, place = (c.to_numpy(zero_copy_only=False) for c in cols)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        of = np.repeat(sizes, sizes)
        to_end = np.repeat(starts + sizes, sizes) - np.arange(len(key))
        long = of > RUN_PAIRS
        if long.any():
            yield from members((key[long], rep[long], n[long], place[long]))
        at = np.flatnonzero((to_end > 1) & ~long)
        gap = 1
        while len(at):
            x, y = n[at], n[at + gap]
            hit = at[(np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9) & (rep[at] != rep[at + gap])]
            if len(hit):
                yield batch_of(schema, key[hit], rep[hit], rep[hit + gap], n[hit], n[hit + gap])
            gap += 1
            at = at[to_end[at] > gap]

    dealt = keys.repartition("key").sortWithinPartitions("key", "rep")
    return dealt.mapInArrow(lambda batches: _runs(batches, 4, solve, RUN_PAIRS, members), "key long, a long, b long, na int, nb int")


def sketch_forest(cols: list, similarity: float) -> np.ndarray:
    """The member from which each member (n, place of the key, sketch) of a run is reached over pairs that may have the
    similarity (a first one: itself): their sizes, what can follow the key in both, and their sketches allow it.

    Breadth first.  Sketches of one width are a matrix; of a pair, one is folded if its width is twice the other's,
    and sizes that allow the similarity are never further apart.
    """
    n, place = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols[:2])
    raw = cols[2].to_pylist()
    width = np.array([len(x) for x in raw])
    where, whole, folded = np.zeros(len(n), np.int64), {}, {}
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w)
        where[some] = np.arange(len(some))
        whole[w] = np.frombuffer(b"".join([raw[i] for i in some.tolist()]), np.uint8).reshape(len(some), w)
        folded[w] = whole[w][:, : w // 2] ^ whole[w][:, w // 2 :]
    words = {w: {w: np.ascontiguousarray(x).view(np.uint64), w // 2: np.ascontiguousarray(folded[w]).view(np.uint64 if w > 8 else np.uint32)} for w, x in whole.items()}
    rest = {w: np.flatnonzero(width == w) for w in whole}
    parent = np.arange(len(n))
    apart, shared = (1 - similarity) / (1 + similarity), similarity / (1 + similarity)
    for first in range(len(n)):
        if first not in rest[width[first]][:1]:
            continue
        rest[width[first]] = rest[width[first]][1:]
        frontier = [first]
        while frontier:
            x = frontier.pop()
            for w in (width[x] // 2, width[x], width[x] * 2):
                if w not in rest or not len(rest[w]):
                    continue
                low = min(w, width[x])
                at = rest[w]
                total = n[at] + n[x]
                near = np.minimum(n[at] - place[at], n[x] - place[x]) >= shared * total - 1e-9
                near &= np.minimum(n[at], n[x]) >= similarity * np.maximum(n[at], n[x]) - 1e-9
                differ = np.bitwise_count(words[w][low][where[at[near]]] ^ words[width[x]][low][where[x]]).sum(axis=1, dtype=np.int64)
                near[near] = differ <= apart * total[near] + 1e-9
                reached = at[near]
                parent[reached] = x
                frontier += reached.tolist()
                rest[w] = at[~near]
    return parent


def run_forest(cols: list, similarity: float) -> np.ndarray:
    """The member from which each member (set of hashes) of a family is reached over links of the similarity (a first
    one: itself).

    Breadth first; a set leaves the search only on a link that is verified, so the forest has exactly the components
    of all links of the run.  Shingles that many sets have are counted as bits, the others from lists of their sets.
    """
    offsets, values = cols[0].offsets.to_numpy(), cols[0].values.to_numpy(zero_copy_only=False)
    sets = [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    m = len(sets)
    size = np.array([len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(m), size)
    many = count > max(1, m // 16)
    column = np.cumsum(many) - 1
    bits = np.zeros((m, int(many.sum()) + 63 >> 6), np.uint64)
    hit = many[at]
    c = column[at[hit]]
    np.bitwise_or.at(bits, (member[hit], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
    few = ~hit & (count[at] > 1)
    at, owner = at[few], member[few]  # ascending owners
    order = np.argsort(at, kind="stable")
    listed, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(count)))])
    own = np.searchsorted(owner, np.arange(m + 1))
    parent, waiting = np.arange(m), np.arange(m)
    while len(waiting):
        frontier, waiting = [int(waiting[0])], waiting[1:]
        while frontier and len(waiting):
            x = frontier.pop()
            common = np.bitwise_count(bits[waiting] & bits[x]).sum(axis=1, dtype=np.int64)
            lists = [listed[begin[s] : begin[s + 1]] for s in at[own[x] : own[x + 1]].tolist()]
            if lists:
                common += np.bincount(np.concatenate(lists), minlength=m)[waiting]
            near = common >= similarity * (size[waiting] + size[x] - common) - 1e-9
            reached, waiting = waiting[near], waiting[~near]
            parent[reached] = x
            frontier += reached.tolist()
    return parent


def forests(cells: DataFrame, payload: list[str], forest) -> DataFrame:
    """Links (a, b) of the members of a table (cell, member, *payload), a forest for each cell."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(cols):
        cell, member = (c.to_numpy(zero_copy_only=False) for c in cols[:2])
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist()
        for s, e in zip(starts, [*starts[1:], len(cell)], strict=True):
            parent = forest([c.slice(s, e - s) for c in cols[2:]])
            hung = np.flatnonzero(parent != np.arange(e - s))
            if len(hung):
                yield batch_of(schema, member[s + hung], member[s + parent[hung]])

    dealt = cells.select("cell", "member", *payload).repartition("cell").sortWithinPartitions("cell", "member")
    return dealt.mapInArrow(lambda batches: _runs(batches, 2 + len(payload), solve), "a long, b long")


def spanning_links(rows: DataFrame, payload: list[str], forest, block: int, attach=lambda rows: rows) -> DataFrame:
    """Links (a, b) with the components of all links within the groups of a table (group, member, *payload).
    ``attach`` adds what is wide of the payload to rows, when they are dealt.

    A group of up to ``block`` members is one cell.  A larger one is dealt into blocks; then one member of each
    component that a block found meets the others' ones; then those still outside the group's largest component
    meet all of the group, block by block.  So a group of copies costs little more than its size, and every pair whose
    ends aren't joined yet is compared.
    """
    large = stored(rows.groupBy("group").agg(F.count("*").alias("m")).where(F.col("m") > block), "near-large")
    if not large.limit(1).count():
        return forests(attach(rows.withColumn("cell", F.col("group"))), payload, forest)
    part = lambda n, seed=0: F.pmod(F.xxhash64("member", F.lit(seed)), F.ceil(F.col(n) / block))
    dealt = rows.join(large, "group", "left").withColumn("cell", F.when(F.col("m").isNull(), F.col("group")).otherwise(F.xxhash64("group", part("m"))))
    dealt = stored(attach(dealt), "near-dealt")
    first = stored(forests(dealt, payload, forest), "near-first")
    hot = dealt.where("m is not null").drop("cell")

    def labelled(links: DataFrame) -> DataFrame:
        found = connected_components(links).select(F.col("u").alias("member"), F.col("v").alias("label"))
        return hot.select("group", "member", "m").join(found, "member", "left").withColumn("label", F.coalesce("label", "member"))

    chiefs = labelled(first).groupBy("group", "label").agg(F.min("member").alias("member")).drop("label")
    counted = chiefs.groupBy("group").agg(F.count("*").alias("c"))
    chiefs = hot.join(chiefs, ["group", "member"]).join(counted, "group").withColumn("cell", F.xxhash64("group", part("c", 1)))
    links = stored(first.unionByName(forests(chiefs, payload, forest)), "near-second")
    named = stored(labelled(links), "near-named")
    main = named.groupBy("group", "label").agg(F.count("*").alias("k")).groupBy("group").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    outside = stored(named.join(main, "group").where("label <> main").select("group", "member").distinct(), "near-outside")
    if not outside.limit(1).count():
        return links
    counted = outside.groupBy("group").agg(F.count("*").alias("c"))
    every = hot.join(counted, "group")
    rest = every.join(outside, ["group", "member"], "left_semi")
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / block) - 1))
    columns = ["group", "member", *payload, "i", "j"]
    cells = rest.withColumn("i", part("c", 2)).withColumn("j", steps("m")).select(columns).unionByName(every.withColumn("j", part("m", 3)).withColumn("i", steps("c")).select(columns))
    return links.unionByName(forests(cells.withColumn("cell", F.xxhash64("group", "i", "j")), payload, forest))


def shingle_sets(base: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(group, member, had: hashes of shingles) of the texts of a table (doc_id, text) in a table (group, member)."""
    schema = pa.schema([("group", pa.int64()), ("member", pa.int64()), ("had", pa.list_(pa.int64()))])

    def run(batches):
        for b in slices(batches, 1024, 8 << 20):
            had = [shingle_hashes(t, shingle).view(np.int64) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(had, pa.list_(pa.int64()))], schema=schema)

    if members.count() * 16 <= BROADCAST_BYTES:
        members = F.broadcast(members)
    texts = base.select(F.col("doc_id").alias("member"), "text").join(members, "member").select("group", "member", "text")
    return texts.mapInArrow(run, "group long, member long, had array<long>")


def sketches_allow(links: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of a table (a, b, na, nb) whose sketches allow the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    apart = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in slices(batches, 4096, 16 << 20):
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(a)) if sketch_difference(x[i], y[i]) <= apart * (na[i] + nb[i]) + 1e-9]
            if keep:
                yield batch_of(schema, [a[i] for i in keep], [b[i] for i in keep])

    both = links.join(prints.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a")
    both = both.join(prints.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, tkey (SHA-256 of the text), component_id (smallest doc_id among near copies, itself
    included).

    Near copies share five-word shingles at a Jaccard similarity of 0.8 or more.  All such pairs meet at a key of the
    prefix filter and lie within a family, whatever their sizes, and every link is verified on the whole sets.  Equal
    texts meet before, so the rows of a key have different texts.  Texts without words are one group.  Texts of one
    doc_id are one document; those whose doc_ids are all null have no links.  Components take 60 rounds at most, each
    of which halves long paths; beyond that an error is raised.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("tkey", F.unhex(F.sha2("text", 256)))
    ids = stored(base.select("doc_id", "tkey"), "near-ids")
    reps = stored(ids.groupBy("tkey").agg(F.min("doc_id").alias("rep")), "near-reps")
    again = stored(ids.join(reps, "tkey").where("not (doc_id <=> rep) or rep is null").select("doc_id", "tkey").distinct(), "near-again")
    hint = F.broadcast if again.count() * 40 <= BROADCAST_BYTES else lambda x: x
    chief = base.alias("x").join(hint(again).alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.tkey") == F.col("y.tkey")), "left_anti")
    frequent, n_hot = frequent_shingles(chief, shingle)
    prints = stored(prints_of(chief, shingle, similarity, frequent), "near-prints")
    keys = prints.select(F.col("doc_id").alias("rep"), "n", F.posexplode("keys").alias("at", "key")).select("key", "rep", "n", "at")
    # A hot shingle's texts count as a long run, however many they are: their rows needn't meet in one task.
    hot = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in frequent[len(frequent) - n_hot :].view(np.int64).tolist()], "key long"))
    met = stored(prefix_pairs(keys.join(hot, "key", "left_anti"), similarity), "near-met")
    apart = keys.join(hot, "key", "left_semi").select(F.col("key").alias("group"), F.col("rep").alias("member"), "n", F.col("at").alias("place"))
    seen = met.where("b is null").select(F.col("key").alias("group"), F.col("a").alias("member"), F.col("na").alias("n"), F.col("nb").alias("place"))
    long = stored(seen.unionByName(apart), "near-runs")
    # Of two texts, x with the lesser last key: shingles in common are keys of both, or among x's others.  So a pair
    # needs this many common keys; those in long runs are at most the fewer of the two texts' keys there.
    common = met.where("b is not null").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    in_long = stored(long.groupBy("member").agg(F.count("*").alias("k")), "near-long")
    for end, k in (("a", "ka"), ("b", "kb")):
        common = common.join(in_long.select(F.col("member").alias(end), F.col("k").alias(k)), end, "left")
    enough = F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb"))
    others = F.ceil(F.lit(similarity) * F.greatest("na", "nb") - 1e-9) - 1
    met_at = F.col("c") + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    short = stored(common.where(met_at + others >= enough - 1e-9).select("a", "b", "na", "nb"), "near-short")
    sketched = lambda rows: rows.join(prints.select(F.col("doc_id").alias("member"), "sketch"), "member")
    maybe = sketches_allow(short, prints, similarity).unionByName(spanning_links(long, ["n", "place", "sketch"], lambda cols: sketch_forest(cols, similarity), RUN_BLOCK, sketched))
    families = connected_components(maybe)
    for no_longer_read in (prints, met, long, in_long, short):
        discard(no_longer_read)
    members = stored(families.select(F.col("v").alias("group"), F.col("u").alias("member")).unionByName(families.select(F.col("v").alias("group"), F.col("v").alias("member")).distinct()), "near-families")
    sets = stored(shingle_sets(chief, members, shingle), "near-sets")
    found = connected_components(spanning_links(sets, ["had"], lambda cols: run_forest(cols, similarity), FAMILY_BLOCK))
    discard(sets)
    found = found.select(F.col("u").alias("rep"), "v")
    classes = reps.join(found, "rep", "left").select("tkey", F.coalesce("v", "rep").alias("component_id"))
    return ids.join(classes, "tkey", "left").select("doc_id", "tkey", "component_id")
