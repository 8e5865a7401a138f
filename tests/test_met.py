"""Pairs that are made where their records meet: the same as by brute force, and none is shuffled or made distinct."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking as B
from matchloom.operators import met
from matchloom.plans import catalogue
from matchloom.sources import tsv


def made(spark, seed=5, copies=400):
    r = random.Random(seed)
    words = [f"word{i}x" for i in range(30)]
    names = [" ".join(r.sample(words, r.randint(1, 4))) for _ in range(300)] + ["the hot name"] * copies + ["word1x", "", "ab", "an of a", "an of a"] * 3
    raw = [(f"S{1 + i % 3}-{i}", n, "", "us" if i % 5 else "fr") for i, n in enumerate(names)]
    rows = tsv.records(spark.createDataFrame(raw, tsv.RECORD)).cache()
    return rows.where("entity_id like 'S1-%'"), rows.where("entity_id not like 'S1-%'")


def above_the_join(df):
    """Operators of the plan that all pairs go through."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return " ".join(plan[: next(i for i, line in enumerate(plan) if "Join" in line)])


@pytest.mark.parametrize("repeated", [False, True])
def test_pairs_equal_brute_force(spark, repeated):
    s1, others = made(spark)
    if repeated:
        others = others.union(others.limit(50)).cache()
    rare = {(x.n, x.token) for x in B.rare_tokens_train(others).collect()}
    a, b = ([(x.entity_id, x.country_norm, x.norm_name, set(x.name_tokens)) for x in side.collect()] for side in (s1, others))
    same = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] == y[2] and len(x[2]) >= 3}
    by_token = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and any((x[1], t) in rare for t in x[3] & y[3])}
    tokens = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[3] and x[3] == y[3]}
    for got, want in ((B.exact_name_pairs, same), (B.rare_token_pairs, by_token), (B.sorted_token_pairs, tokens), (B.met_pairs, same | by_token)):
        rows = [tuple(x) for x in got(s1, others).collect()]
        assert len(rows) == len(set(rows)) == len(want) and set(rows) == want


def test_no_pair_is_made_distinct(spark):
    s1, others = made(spark)
    for f in (B.exact_name_pairs, B.rare_token_pairs, B.sorted_token_pairs):
        above = above_the_join(f(s1, others))
        assert "Aggregate" not in above and "Generate explode" in above


def test_copies_meet_by_chunks(spark):
    s1, others = made(spark)
    a, b = met.keyed(s1, others, B.rare_tokens_train(others))
    assert a.agg(F.max(F.size("ids_a"))).first()[0] < 3 * met.CHUNK and a.agg(F.sum(F.size("ids_a"))).first()[0] == s1.count()
    assert met.by_either(a, b).count() < B.met_pairs(s1, others).count() / 10


@pytest.mark.parametrize("name", ["label_pairs", "pair_lexical_features", "positive_pairs", "recall_ceiling", "candidate_stats"])
def test_scored_pairs_are_not_joined_again(spark, sf, name):
    """What a pair needs comes with its records: nothing is joined to pairs."""
    df = catalogue.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "source1_entity_id" not in " ".join(x for x in plan.splitlines() if "Join " in x)


def test_neighbours_in_blocks_keep_the_last_bits(spark):
    """Sums that differ in the last digits are no tie, equal ones go to the smaller id, and blocks don't matter."""
    from matchloom.operators import cells

    rows = spark.createDataFrame([("q", "us", [1.0, 1.0]), ("a", "us", [0.5, 0.25]), ("b", "us", [0.5, 0.25 + 2e-14]), ("d", "us", [0.5, 0.25]), ("c", "fr", [9.0, 9.0])], "entity_id string, country_norm string, embedding array<double>")
    got = cells.knn_pairs_blocks(rows.where("entity_id = 'q'"), rows.where("entity_id <> 'q'"), 2).collect()
    assert sorted((r[1], r.sim) for r in got) == [("a", 0.75), ("b", 0.75 + 2e-14)]
    assert "CoGroups" in catalogue.QUERIES["knn_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_strata_need_no_lists(spark, sf):
    plan = catalogue.QUERIES["stratified_sample"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


@pytest.mark.parametrize("name", ["best_candidates", "merge_candidates"])
def test_best_pairs_come_from_the_index(spark, sf, name):
    """No table of all pairs is ranked: what reaches the last ranking is what the index opened."""
    files = " ".join(catalogue.QUERIES[name](spark, sf).inputFiles())
    assert "blockmax-first" in files and "met-a" not in files


def test_cosines_are_products_of_blocks(spark):
    """The same cosines as by a map per pair, whatever the blocks; a pair of two common tokens comes once."""
    from matchloom.operators import tfidf

    s1, others = made(spark, copies=100)
    rare = B.rare_tokens_train(others, 0.3)
    got = [tuple(r) for r in tfidf.name_cosines(s1, others, rare, "c").collect()]
    idf = tfidf.fit(s1.select("norm_name").union(others.select("norm_name")), "norm_name")
    left, right = (tfidf.weigh(x, idf, "entity_id", "norm_name") for x in (s1, others))
    pairs = B.rare_token_pairs(s1, others, rare).union(B.exact_name_pairs(s1, others)).distinct()
    want = {r[:2]: r[2] for r in map(tuple, tfidf.pair_cosine(pairs, left, right, *B.PAIR, "c").collect())}
    assert len(got) == len(want) and all(abs(want[r[:2]] - r[2]) < 1e-9 for r in got)


@pytest.mark.parametrize("few", [0, 1024])
def test_chunks_meet_in_cells_of_any_size(spark, monkeypatch, few):
    """The same pairs and scores as by joins, whatever the cells; pairs of a row are gathered by score, or counted."""
    s1, others = made(spark, copies=200)
    a, b = met.keyed(s1, others, B.rare_tokens_train(others, 0.3))
    monkeypatch.setattr(met, "SIDE", 5)
    monkeypatch.setattr(met, "FEW", few)
    want = sorted(map(tuple, met.pairs(met.by_either(a, b).withColumn("prob", F.round(met.jaccard(), 6)), "prob").collect()))
    cells = lambda **x: met.in_cells(a, b, met.scores, "prob double", ["tokens"], **x)
    assert want == sorted(map(tuple, met.pairs(cells(), "prob").collect())) == sorted(map(tuple, met.pairs(cells(gather=False), "prob").collect()))
    assert cells().count() < cells(gather=False).count()
    sums = cells(sizes=True).join(a.select("chunk_a", F.size("ids_a").alias("k")), "chunk_a").groupBy("prob").agg(F.sum(F.col("m") * F.col("k")))
    assert dict(map(tuple, sums.collect())) == {p: sum(r[2] == p for r in want) for p in {r[2] for r in want}}


@pytest.mark.parametrize("name", ["rare_token_pairs", "label_pairs", "group_split", "macro_f05", "threshold_grid"])
def test_pairs_are_told_in_cells(spark, sf, name):
    """No row per pair and token is joined, and group_split makes its pairs once."""
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CoGroups") == 1 and "array_intersect" not in plan
