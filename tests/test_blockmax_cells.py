"""The rare-token index where lists and queries meet in cells: what is stored doesn't grow with the pairs, and the candidates are those of all pairs."""

import pytest

from matchloom.operators import blocking as B
from matchloom.operators import blockmax
from test_scale import plain_top, rows_of, word_names


def test_a_query_has_k_stored_rows(spark, monkeypatch):
    """Two rows a class, k a query: neither lists of two tokens nor blocks of queries are stored, which grew with the lists."""
    kept, stored = blockmax.kept, []

    def counted(df, tag):
        table = kept(df, tag)
        stored.append(table.count())
        return table

    monkeypatch.setattr(blockmax, "kept", counted)
    (s1, others), k = rows_of(spark, word_names(4, 4000, 60, most=5)), 5
    blockmax.TokenIndex(others, k, 4, B.rare_tokens_train(others, 0.2)).search(s1).count()
    tokens = others.selectExpr("country_norm", "explode(name_tokens)").distinct().count()
    assert sum(stored) <= 2 * others.count() + (k + 2) * s1.count() + tokens


@pytest.mark.parametrize(("side", "k"), [(16, 3), (1, 2)])
def test_lists_cut_into_cells_equal_all_pairs(spark, monkeypatch, side, k):
    """A list of many cells: the same candidates."""
    monkeypatch.setattr(blockmax, "SIDE", side)
    s1, others = rows_of(spark, word_names(5, 300, 30))
    rare = B.rare_tokens_train(others, 0.3)
    index = blockmax.TokenIndex(others, k, 2, rare)
    got = [tuple(r) for r in index.search(s1).collect()]
    assert sorted(got) == sorted(tuple(r) for r in plain_top(s1, others, rare, k).collect())


def test_an_id_of_several_names(spark):
    """An id with two names of one score counts once, also where it would fill the last place."""
    names = "entity_id string, country_norm string, name_tokens array<string>"
    s1 = spark.createDataFrame([("S1-1", "us", ["blue", "river"])], names)
    others = spark.createDataFrame([("S2-1", "us", ["blue", "north"]), ("S2-1", "us", ["blue", "south"]), ("S2-2", "us", ["blue", "west"]), ("S2-3", "us", ["blue", "east"]), ("S2-3", None, ["blue", "river"])], names)
    got = sorted(tuple(r) for r in blockmax.rare_token_topk(s1, others.union(others), 2).collect())
    assert got == []  # "blue" is in more than three records, so it isn't rare
    got = sorted(tuple(r)[:2] for r in blockmax.TokenIndex(others, 2, 1, others.selectExpr("country_norm as n", "explode(name_tokens) as token").distinct()).search(s1).collect())
    assert got == [("S1-1", "S2-1"), ("S1-1", "S2-2")]
