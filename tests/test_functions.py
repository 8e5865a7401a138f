"""Text functions and similarities against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as X


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "name", "addr"),
    [("A&B Co.", "a and b", "a b co"), ("Pvt Ltd", "", "pvt ltd"), ("", "", ""), ("12 Main St., Ste 4", "12 main st ste 4", "12 main street suite 4"), ("रियल केयर प्रा. लि.", "र यल क यर प र ल", "र यल क यर प र ल")],
)
def test_normalize(spark, raw, name, addr):
    df = spark.createDataFrame([(raw,)], "t string")
    row = df.select(X.normalize_name("t").alias("n"), X.normalize_address("t").alias("a")).first()
    assert (row.n, row.a) == (name, addr)


def test_null_is_empty(spark):
    row = spark.createDataFrame([(None,)], "t string").select(X.normalize_name("t").alias("n"), X.significant_tokens("t").alias("s"), X.numeric_tokens("t").alias("m")).first()
    assert (row.n, row.s, row.m) == ("", [], [])


def test_tokens_and_numbers(spark):
    df = spark.createDataFrame([("the big cat of big x", "12 A12 _12 12 007")], "t string, a string")
    row = df.select(X.significant_tokens("t").alias("s"), X.numeric_tokens("a").alias("m")).first()
    assert row.s == ["big", "cat"]
    assert row.m == sorted(set(re.findall(r"\b\d+\b", "12 A12 _12 12 007")))


def test_similarities(spark):
    df = spark.sql("select array('a','b') x, array('b','c') y, cast(array() as array<string>) e, 'kitten' k, 'sitting' s, '' z")
    row = df.select(S.jaccard("x", "y").alias("j"), S.jaccard("e", "e").alias("both"), S.jaccard("x", "e").alias("one"), S.lev_ratio("k", "s").alias("l"), S.lev_ratio("z", "z").alias("ee"), S.postal_cmp(F.lit("1"), F.lit("2")).alias("p"), S.postal_cmp(F.lit(""), F.lit("2")).alias("q")).first()
    assert (row.j, row.both, row.one, row.ee, row.p, row.q) == (1 / 3, 1.0, 0.0, 1.0, -1.0, 0.0)
    assert abs(row.l - (1 - 3 / 7)) < 1e-12


def test_lev_above_is_strict(spark):
    base = "abcdefghij"
    rows = [(base, base), (base, "abcdefghiX"), (base * 2, base + "abcdefghiX"), ("", ""), ("a", "b")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.x for r in df.select(S.lev_above("a", "b").alias("x")).collect()] == [True, False, True, True, False]


def test_char_grams(spark):
    def plain(t):
        return sorted(p[i : i + n] for w in t.split() for p in [f" {w} "] for n in (2, 3, 4) for i in range(len(p) - n + 1))

    for t in ("a bc def", "", "aaaa aaaa"):
        assert sorted(one(spark, X.char_grams("t"), t=t)) == plain(t)


def test_postal(spark):
    from matchloom.plans import fixtures

    assert {r.case_id: r.code for r in fixtures.postal_cases(spark).collect()} == {1: "", 2: "560001", 3: "12345", 4: "75008", 5: "", 6: "1234", 7: "", 8: "98765"}
