"""Decontamination, whitening and join maintenance against brute force and SQL."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import decontaminate, join_feed, queries, whitening, zset

DOCS = "doc_id long, text string, item_id long, n_words int, `start` long, words string"


def say(r, n, words=40):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    items = [(k, say(r, r.randint(11, 60), 400)) for k in range(12)]
    items += [(20, "Short one, of 5 Words"), (21, "été"), (22, ""), (23, None), (None, say(r, 30, 400)), (3, say(r, 15, 400)), (24, items[0][1] + " " + items[1][1]), (25, "same same same same same same same same same same same same same"), (5, items[5][1])]
    text = [t for _, t in items if t]
    docs = [(0, None), (1, ""), (2, " \n"), (3, text[0]), (3, text[0]), (None, text[1].upper()), (4, "x " + text[2].replace(" ", "--") + " y"), (5, " ".join(text[3].split()[:9])), (6, " ".join(text[3].split()[:10]) + " z"), (7, "a short ONE of 5 words, ÉTÉ été"), (8, "same " * 400)]
    for i in range(40):
        own = text[r.randrange(len(text))].split()
        at, n = r.randrange(len(own)), r.randint(1, 30)
        docs.append((10 + i, f"{say(r, r.randint(0, 50), 4000)} {' '.join(own[at : at + n])} {say(r, r.randint(0, 50), 400)}"))
    docs.append((99, f"{say(r, 5000, 4000)} {text[4]} {say(r, 3000, 4000)} {text[4]} {text[6]}"))
    return docs, items


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = split(t)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[s : s + window])].add(k)
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= own
        yield d, len(w), len(hit), sorted(str(k) for k in found if k is not None)


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 7, 1, 2, "c") for d, t in docs], DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("piece", "block", "shard"), [(1 << 12, 1 << 18, 1 << 20), (20, 60, 200), (20, 10**6, 300)])
def test_decontaminate(spark, corpus, piece, block, shard):
    docs, items = corpus
    rows, bench = frames(spark, docs, items)
    made = decontaminate.Benchmark(bench, piece_words=piece, block_words=block)
    assert made.blocks == (1 if block > 1000 else made.blocks) and (block > 1000 or made.blocks > 3)
    got = decontaminate.search(rows, made, shard_words=shard).collect()
    want = list(brute(docs, items))
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in got) == collections.Counter((d, n, h, tuple(k)) for d, n, h, k in want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) for r in got)
    kept = decontaminate.decontaminate(rows, made, shard_words=shard)
    assert kept.columns == rows.columns
    clean = [(d, t) for (d, t), x in zip(docs, want, strict=True) if not x[2]]
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(clean)


def longest(docs, items):
    best = {}
    for k, t in items:
        p = split(t)
        for d, x in docs:
            w = split(x)
            at = collections.defaultdict(list)
            for s, y in enumerate(w):
                at[y].append(s)
            for i in range(len(p)):
                for s in at[p[i]]:
                    n = 0
                    while i + n < len(p) and s + n < len(w) and p[i + n] == w[s + n]:
                        n += 1
                    if k is not None and n > best.get(k, 0):
                        best[k] = n
    return best


@pytest.mark.parametrize("shard", [1 << 20, 400])
def test_longest_matches(spark, corpus, shard):
    docs, items = corpus
    items = [x for x in items if len(split(x[1])) >= 10]
    rows, bench = frames(spark, docs, items)
    got = decontaminate.longest_matches(rows, decontaminate.Benchmark(bench), shard_words=shard).collect()
    best = longest(docs, items)
    assert {r.item_id: r.n_words for r in got} == {str(k): n for k, n in best.items() if n >= 10}
    for r in got:
        own = [split(t) for k, t in items if str(k) == r.item_id]
        there = [split(t) for d, t in docs if d == r.doc_id]
        assert any(p[r.item_start : r.item_start + r.n_words] == w[r.doc_start : r.doc_start + r.n_words] for p in own for w in there)


def test_decontaminate_empty(spark, corpus):
    docs, items = corpus
    rows, bench = frames(spark, docs, items)
    none = decontaminate.Benchmark(bench.where("false"))
    assert decontaminate.search(rows, none).agg({"n_hit": "sum"}).first()[0] == 0 and decontaminate.decontaminate(rows, none).count() == len(docs)
    assert decontaminate.longest_matches(rows, none).count() == 0
    assert decontaminate.search(rows.where("false"), decontaminate.Benchmark(bench)).count() == 0


def test_suffix_array_by_sorting():
    r = np.random.default_rng(1)
    for n, v in ((1, 1), (50, 2), (400, 3), (3000, 9), (500, 1)):
        ids = np.append(r.integers(0, v + 1, n), 0)
        key = lambda p: ids[p : p + 1 + int(np.flatnonzero(ids[p:] == 0)[0])].tolist()  # noqa: E731, B023
        want = sorted(np.flatnonzero(ids).tolist(), key=lambda p: (key(p), p))
        got = decontaminate.suffix_array(ids, 10**6).tolist()
        assert [key(p) for p in got] == [key(p) for p in want] and sorted(got) == sorted(want)


def same(got, want):
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_op11_sql_of_odd_rows(spark, corpus, tmp_path):
    docs, items = corpus
    rows, bench = frames(spark, docs, items)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    df = queries.op11_decontaminate(spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    same(df.collect(), c.sql(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL['op11_decontaminate']})").fetchall())


def vectors(n=400, dims=40, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)) @ np.diag(np.linspace(3, 0.2, dims)) @ r.normal(size=(dims, dims)) / 6
    return [(i, v.astype(np.float32).tolist(), 1, 2.0, 3) for i, v in enumerate(x)]


VECTORS = "vec_id long, embedding array<float>, n long, whitened double, x int"


def test_whiten(spark):
    odd = [(1000, None, 0, 0.0, 0), (1001, [], 0, 0.0, 0), (1002, [None] + [0.5] * 39, 0, 0.0, 0), (1003, [float("nan")] * 40, 0, 0.0, 0), (1004, [float("inf")] * 40, 0, 0.0, 0), (1005, [1.0, 2.0], 0, 0.0, 0), (1006, [3e38] * 40, 0, 0.0, 0)]
    rows = [*vectors(), (7, vectors()[7][1], 0, 0.0, 0), (None, vectors()[9][1], 0, 0.0, 0)]
    got = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(40), fan=3).collect()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    d = n * x - s
    v = (d / n).T @ (d / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    assert len(got) == 32 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    own = collections.defaultdict(list)
    for r in got:
        own[r.vec_id].append(r)
    want = (d / n) @ u / np.sqrt(e)
    signs = np.sign([next(r.whitened for r in own[0] if r.component == k + 1) * want[0, k] for k in range(32)])
    for i, row in enumerate(rows):
        mine = sorted(own[row[0]], key=lambda r: r.component)
        assert {r.deviation for r in mine} == {int((d[i].astype(object) ** 2).sum())}
        assert any(np.allclose([r.whitened for r in mine[j::times]], want[i] * signs, atol=1e-8) for times in (len(mine) // 32,) for j in range(times)), i
        assert np.allclose([r.explained for r in mine[:: len(mine) // 32]], e / np.trace(v), rtol=1e-9)


def test_whiten_degenerate(spark):
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i], 0, 0.0, 0) for i in range(50)], VECTORS)
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert whitening.whiten(flat.where("false")).count() == 0 and whitening.whiten(flat.where("vec_id = 3")).count() == 0
    far = spark.createDataFrame([(i, [1e12 * (-1) ** i, float(i)], 0, 0.0, 0) for i in range(20)], VECTORS)
    rows = whitening.whiten(far).collect()
    assert rows and all(r.deviation is None for r in rows) and all(np.isfinite(r.whitened) for r in rows)


def feed(rows, prefix, t):
    """What a table holds after batch t."""
    c = lambda d, k: zlib.crc32(f"{prefix}:{'null' if d is None else d}:{k}".encode())
    for row in rows:
        d, updates, present = row[0], 0, c(row[0], 0) % 3 != 0
        for k in range(1, t + 1):
            what = c(d, k) % 19
            if what == 0:
                present = not present
            elif what == 1 and present:
                updates += 1
        if present:
            yield row, updates


def joined(docs, labels, t):
    say_ = lambda v: "null" if v is None else str(v)
    left, out = collections.defaultdict(list), collections.Counter()
    for (d, lang), u in feed(docs, "d", t):
        if d is not None:
            left[d // 3 + u].append(say_(lang))
    for (d, quality, toxic), u in feed(labels, "l", t):
        q = 1 - quality if u % 2 and quality is not None else quality
        k = None if d is None else d // 3
        for part in (left.get(k, ()) if k is not None else ()) or ["-"]:
            out[k, part, f"{say_(q)},{say_(toxic)}"] += 1
    return out


def shop(n):
    r = random.Random(8)
    docs = [(i, r.choice(["en", "fr", None, ""])) for i in range(n)] + [(None, "en")] * 3 + [(5, "de"), (5, "de"), (-4, "en"), (-5, "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(n + 20) if r.random() < 0.7] + [(None, 1, 0), (None, 1, 0), (5, 0, 1), (-4, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("share", [0.5, 0.0, 1e9])
def test_join_maintenance(spark, share):
    docs, labels = shop(240)
    left, right = spark.createDataFrame(docs, "doc_id long, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    circuit = zset.RightOuterJoin("join_key", {"doc_part": F.lit("-")}, merge_share=share)
    before = collections.Counter()
    for t in range(4):
        got = circuit.step(join_feed.changes(left, "d", t, join_feed.document_rows), join_feed.changes(right, "l", t, join_feed.label_rows)).collect()
        after = joined(docs, labels, t)
        want = {k: (after[k] - before[k], after[k]) for k in {*after, *before} if after[k] != before[k]}
        assert {(r.join_key, r.doc_part, r.label_part): (r.weight, r.total) for r in got} == want and len(got) == len(want), t
        before = after
    assert len(circuit.out.layers) == (4 if share > 1 else 1 if share == 0 else len(circuit.out.layers))


def test_join_of_hot_key_and_empty_batches(spark):
    left = zset.zset(spark.range(3000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("a")))
    right = zset.zset(spark.range(2000).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("b")))
    circuit = zset.RightOuterJoin("k")
    nothing = zset.empty_like(left), zset.empty_like(right)
    assert circuit.step(*nothing).count() == 0
    first = circuit.step(nothing[0], right).collect()
    assert {(r.k, r.a, r.b): (r.weight, r.total) for r in first} == {(1, None, b): (1000, 1000) for b in (0, 1)}
    second = circuit.step(left, nothing[1]).collect()
    assert {(r.k, r.a, r.b): (r.weight, r.total) for r in second} == {(1, a, b): (10**6, 10**6) for a in range(3) for b in (0, 1)} | {(1, None, b): (-1000, 0) for b in (0, 1)}
    third = circuit.step(zset.negate(left), nothing[1]).collect()
    assert {(r.a, r.weight, r.total) for r in third} == {(None, 1000, 1000)} | {(a, -(10**6), 0) for a in range(3)}
    assert circuit.step(*nothing).count() == 0


def test_nodes_of_the_circuit(spark):
    z = lambda *rows: spark.createDataFrame(list(rows), "x int, weight long")
    rows = lambda d: sorted(map(tuple, zset.consolidate(d).collect()))
    delay, change, distinct = zset.Delay(), zset.Differentiate(), zset.Distinct()
    assert rows(delay.step(z((1, 2)))) == [] and rows(delay.step(z((5, 1)))) == [(1, 2)]
    assert rows(change.step(z((1, 2), (2, 1)))) == [(1, 2), (2, 1)] and rows(change.step(z((1, 3)))) == [(1, 1), (2, -1)]
    assert rows(distinct.step(z((1, -2), (2, 5), (3, 1)), z((1, 2), (2, 1), (4, 1)))) == [(1, -1), (3, 1)]
    assert rows(zset.bilinear(z((1, 2), (2, 1)).withColumnRenamed("x", "k"), z((1, 3)).withColumnRenamed("x", "k"), "k")) == [(1, 6)]


def test_contract_columns(spark, sf):
    assert queries.op12_whiten(spark, sf).dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in queries.op11_decontaminate(spark, sf).collect()}
