"""Block-max index, segment index, cell tree and balanced joins against the plain ways, and how their work grows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking as B
from matchloom.operators import blockmax, cells, embedding, segments, skew
from matchloom.plans import fixtures as fx
from matchloom.sources import tsv


def rows_of(spark, names, sources=3):
    raw = [(f"S{1 + i % sources}-{i}", n, "", c) for i, (n, c) in enumerate(names)]
    rows = tsv.records(spark.createDataFrame(raw, tsv.RECORD)).cache()
    return rows.where("entity_id like 'S1-%'"), rows.where("entity_id not like 'S1-%'")


def plain_top(s1, others, rare, k):
    a = s1.select(F.col("entity_id").alias(B.PAIR[0]), F.col("name_tokens").alias("ta"))
    b = others.select(F.col("entity_id").alias(B.PAIR[1]), F.col("name_tokens").alias("tb"))
    pairs = B.rare_token_pairs(s1, others, rare).join(a, B.PAIR[0]).join(b, B.PAIR[1])
    shared = F.size(F.array_intersect("ta", "tb"))
    return B.top_k(pairs.select(*B.PAIR, (shared / (F.size("ta") + F.size("tb") - shared)).alias("score")), k, "score")


def word_names(seed, n, words, most=7):
    r = random.Random(seed)
    vocabulary = [f"word{i}x" for i in range(words)]
    pick = lambda: vocabulary[min(int(r.expovariate(0.15)), words - 1)]
    names = [(" ".join(pick() for _ in range(r.randint(1, most))), r.choice(["us", "us", "us", "fr"])) for _ in range(n)]
    return names + [names[0]] * 60 + [("", "us"), ("a an", "us"), (None, "fr"), ("word1x", "us")] * 2


@pytest.mark.parametrize(("k", "block", "fraction"), [(20, 32, 0.02), (3, 2, 0.3), (2, 4, 1.0), (1, 1, 0.1)])
def test_blockmax_equals_all_pairs(spark, k, block, fraction):
    s1, others = rows_of(spark, word_names(k, 700, 40))
    rare = B.rare_tokens_train(others, fraction)
    got = [tuple(r) for r in blockmax.TokenIndex(others, k, block, rare).search(s1).collect()]
    assert sorted(got) == sorted(tuple(r) for r in plain_top(s1, others, rare, k).collect())


def test_blockmax_opens_few_classes(spark):
    """Ten times the records: the pairs that share a rare token grow with the square, those that are looked at far less."""
    looked, pairs = [], []
    for n in (800, 8000):
        s1, others = rows_of(spark, word_names(4, n, 60, most=5))
        rare = B.rare_tokens_train(others, 0.2)
        looked.append(blockmax.TokenIndex(others, 5, 4, rare).looked_at(s1).count() / s1.select("name_tokens").distinct().count())
        pairs.append(B.rare_token_pairs(s1, others, rare).count() / s1.count())
    print(looked, pairs)
    assert pairs[1] > 8 * pairs[0] and looked[1] / looked[0] < 0.4 * pairs[1] / pairs[0]


def test_blockmax_without_records(spark):
    s1, others = rows_of(spark, [("", "us"), (None, "fr"), ("blue river", "us")])
    assert blockmax.rare_token_topk(s1, others).count() == blockmax.rare_token_topk(s1.where("false"), others).count() == 0


def test_segments_equal_prefixes_and_tokens(spark):
    r = random.Random(6)
    base = ["société générale de lyon centre " + "x" * i for i in range(0, 60, 4)] + ["abc", "abcd", "abcdefghij", "blue river trading house of the north", "müller straße café nord"]
    letters = "abcdefgh éü"

    def changed(name):
        out = list(name)
        for _ in range(r.randint(0, 1 + len(out) // 9)):
            at = r.randrange(len(out))
            how = r.randrange(3)
            out[at : at + (how != 2)] = [r.choice(letters)] if how else []
            out = out or ["z"]
        return "".join(out)

    names = [(changed(r.choice(base)), r.choice(["us", "fr"])) for _ in range(900)] + [(base[3], "us")] * 30 + [("", "us"), (None, "us"), ("ab", "fr")]
    s1, others = rows_of(spark, names)
    got = [tuple(x) for x in segments.fuzzy_name_pairs(s1, others).collect()]
    want = [tuple(x) for x in B.fuzzy_name_pairs(s1, others).collect()]
    assert len(want) > 1000 and sorted(got) == sorted(want)
    assert segments.fuzzy_name_pairs(s1.where("false"), others).count() == 0


def test_segments_measure_fewer_pairs(spark):
    s1, others = fx.sides(spark, "/root/testdata/sf0.01")
    keys = lambda rows, t: rows.where(F.length("norm_name") >= 3).select("country_norm", F.col("entity_id").alias(t), F.length("norm_name").alias(f"l{t}"), F.explode(F.array_distinct(F.concat(F.array(F.substring("norm_name", 1, 3)), F.col("name_tokens")))).alias("key"))
    met = keys(s1, "a").join(keys(others, "b"), ["country_norm", "key"]).where("abs(la - lb) <= greatest(1, floor(0.12 * la))").select("a", "b").distinct().count()
    measured = segments.name_pairs(segments._names(s1, "a"), segments._names(others, "b")).count()
    print(measured, met)
    assert measured < met / 3


@pytest.mark.parametrize("at", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("made_by", ["embeddings", "names"])
def test_tree_recall_and_cell_sizes(spark, made_by, at):
    at = f"/root/testdata/{at}"
    s1, others = fx.vectors(spark, at) if made_by == "embeddings" else [embedding.embed(x) for x in fx.sides(spark, at)]
    s1, others = (x.select("country_norm", "entity_id", "embedding").cache() for x in (s1, others))
    leaf = 32 if made_by == "embeddings" else 128
    tree = cells.CellTree(others, leaf)
    sizes = [r["count"] for r in tree.codes.groupBy("n", "cell").count().collect()]
    assert max(sizes) <= leaf and sum(sizes) == others.count() and tree.levels >= 1
    got = {(r[0], r[1]): r.sim for r in tree.search(s1, 20, tree.fit_beam(s1, 20)).collect()}
    exact = cells.compared(cells._as_queries(s1), cells._as_vectors(others), 20).collect()
    last = {}
    for r in exact:
        last[r.qid] = min(r.sim, last.get(r.qid, 2.0))
    good = sum(s >= last[a] - 1e-6 for (a, _), s in got.items())
    print(made_by, at, tree.levels, len(sizes), good / len(exact))
    assert good >= 0.9 * len(exact)
    sims = {(r.qid, r[2]): r.sim for r in exact}
    assert all(abs(sims[p] - s) < 1e-5 for p, s in got.items() if p in sims)


def test_tree_of_copies_and_nothing(spark):
    one = [0.6, 0.8] + [0.0] * 6
    rows = spark.createDataFrame([(f"S{1 + i % 2}-{i}", "us", one if i % 4 < 3 else [0.0] * 8) for i in range(900)], "entity_id string, country_norm string, embedding array<float>")
    s1, others = rows.where("entity_id like 'S1-%'"), rows.where("entity_id like 'S2-%'")
    tree = cells.CellTree(others, 40)
    assert max(r["count"] for r in tree.codes.groupBy("n", "cell").count().collect()) <= 40
    near = tree.search(s1, 5, 8).collect()
    assert len(near) == 5 * 450 and {round(r.sim, 5) for r in near} <= {0.0, 1.0}
    assert cells.knn_pairs_tree(s1.where("false"), others).count() == cells.knn_pairs_tree(s1, others.where("false")).count() == 0
    assert cells.nearest(s1.where("false"), others).count() == cells.nearest(s1, others.where("false")).count() == 0


def test_auto_takes_the_tree_for_large_countries(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(size=(400, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"S{1 + i % 2}-{i}", "us" if i < 360 else "fr", v.tolist()) for i, v in enumerate(vectors)], "entity_id string, country_norm string, embedding array<float>").cache()
    s1, others = rows.where("entity_id like 'S1-%'"), rows.where("entity_id like 'S2-%'")
    exact = {tuple(x)[:2] for x in B.knn_pairs(s1, others, 5).collect()}
    assert {tuple(x)[:2] for x in cells.nearest(s1, others, 5).collect()} == exact
    mixed = {tuple(x)[:2] for x in cells.nearest(s1, others, 5, exact_pairs=1000, leaf=30).collect()}
    assert len(mixed & exact) >= 0.9 * len(exact) and {p for p in mixed if int(p[0][3:]) >= 360} == {p for p in exact if int(p[0][3:]) >= 360}


def test_balanced_join_of_a_hot_country(spark):
    """Nine tenths of the rows in one country: the same pairs, and no task with over three times the median."""
    make = lambda t, n: spark.range(n).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 37)).alias("n"), F.concat(F.lit(t), F.col("id")).alias(t))
    a, b = make("a", 3000).cache(), make("b", 2000).cache()
    kept = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = skew.balanced_join(a, b, ["n"], "a", "b", tasks=16).repartition(1).select("n", "a", "b")
        parts = skew.balanced_join(a, b, ["n"], "a", "b", tasks=16)
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        sizes = sorted(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for c, v in kept.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    want = a.join(b, ["n"])
    assert got.count() == want.count() == got.intersect(want.select("n", "a", "b")).count()
    print(sizes)
    assert len(sizes) == 16 and sizes[-1] <= 3 * sizes[8]
    assert skew.heavy_keys(a.where("false"), b, ["n"]) is None
