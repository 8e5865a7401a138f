"""The pipeline's stages on small data."""

import collections
import zlib

import numpy as np
from tests.llm.test_operators import brute_near, brute_scan

import corpus_pipeline as P
from matchloom.llm import common, secrets, tokens, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id as `__key`", "'x' as fp").cache()
    toxic = P.drop_toxic(spark, docs, sf)
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert toxic.columns == docs.columns
    assert {r.doc_id for r in toxic.collect()} == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    copies = P.drop_copies(spark, docs, sf)
    last = {}
    for r in docs.collect():
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", -1))
    assert copies.columns == docs.columns and {r.doc_id for r in copies.collect()} == set(last.values())
    near = P.drop_near_copies(spark, copies, sf)
    assert near.columns == docs.columns and 0 < near.count() <= copies.count()
    clean = P.redact_secrets(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    changed = collections.Counter(("[SECRET]" in (a.text or ""), a.text == b.text) for a, b in zip(clean.orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True))
    assert set(changed) <= {(True, False), (False, True)}


def brute_toxic(texts, model):
    """Which texts score 0.5 or more, from the kernel's definition: words against landmarks, one by one."""
    weight = toxicity.DECAY

    def phi(word):
        letters, out = [27, *(ord(c) - 96 for c in word)], collections.Counter()
        for i in range(len(letters)):
            for shape in toxicity.SHAPES:
                if i + shape[-1] < len(letters):
                    out[tuple(letters[i + o] for o in shape)] += weight ** (shape[-1] + 1 - len(shape))
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()} if norm else {}

    marks = [phi(w) for w in model.landmarks]

    def row(word):
        pieces = toxicity.parts(word)
        whole = toxicity.fold(word)
        if len(whole) > toxicity.LONGEST:
            sizes = {len(w) for w in model.landmarks if len(w) <= toxicity.LONGEST}
            pieces = [x for x in pieces if len(x) <= toxicity.LONGEST] + [whole[i : i + n] for n in sizes for i in range(len(whole) - n + 1)]
        kernel = [[sum(v * mark.get(k, 0.0) for k, v in x.items()) for mark in marks] for x in map(phi, pieces)]
        return np.maximum(np.max([[0.0] * len(marks), *kernel], axis=0) - toxicity.FLOOR, 0) / (1 - toxicity.FLOOR)

    known = {w: row(w) for w in {w for t in texts for w in toxicity.words_of(t)}}
    rows = np.array([np.max([np.zeros(len(marks)), *(known[w] for w in toxicity.words_of(t))], axis=0) for t in texts])
    return model.scores(rows) >= 0.5


def test_run_by_brute_force(spark, sf):
    """Every stage on all that its predecessor kept, against a plain version of it; then run() as a whole."""
    sf = sf.replace("sf0.001", "sf0.01")  # the smaller table has too few labels for a landmark
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = {r.doc_id: (r.text or "", r) for r in docs.collect()}
    held = docs
    kept = {}
    for name, stage in P.STAGES:
        before, source = now, held
        held = common.stored(stage(spark, held, sf), "test-stage")
        if name == "packing":
            break
        now = {r.doc_id: (r.text or "", r) for r in held.collect()}
        kept[name] = len(before) - len(now)
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            ids = sorted(before)
            want = {d for d, toxic in zip(ids, brute_toxic([before[d][0] for d in ids], model), strict=True) if not toxic}
        elif name == "exact_dedup":
            want = set({t: d for d, (t, _) in sorted(before.items())}.values())
        elif name == "simhash_near_dedup":
            want = {d for d, c in brute_near([(d, t) for d, (t, _) in before.items()]).items() if d == c}
        else:
            want = set(before)
            base = source.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
            table = secrets.train(secrets.labelled_strings(base))
            for d, (t, r) in before.items():
                assert now[d][0] == brute_scan(t, table)[2] and now[d][1].n_chars == len(now[d][0]) and now[d][1].source == r.source
        assert set(now) == want, name
        assert held.columns == docs.columns
    assert kept["toxicity"] and kept["exact_dedup"] and kept["simhash_near_dedup"] and not kept["secret_scan"], kept
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    pieces = sorted(held.collect(), key=lambda r: (r.doc_id, r.start))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, (t, _) in now.items()}
    at = collections.Counter()
    for r in pieces:
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {d: len(x) for d, x in ids.items()}
    filled = collections.Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert sorted(filled.values())[1:] == [2048] * (len(filled) - 1) and max(filled.values()) <= 2048
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, pieces))


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0
