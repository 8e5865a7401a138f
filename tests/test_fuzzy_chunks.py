"""Fuzzy name pairs from chunks of close names: as by brute force, and nothing that repeats is broadcast."""

from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.operators import blocking as B
from matchloom.sources import tsv


def test_fuzzy_pairs(spark):
    hot = "the quick northern trading house"
    names = [hot] * 150 + [hot[:i] + "x" + hot[i + 1 :] for i in range(4, 24)] + ["northern lights bakery", "northern lights bakeri", "ab", ""] * 3
    raw = [(f"S{1 + i % 3}-{i}", n, "", "us") for i, n in enumerate(names)]
    rows = tsv.records(spark.createDataFrame(raw, tsv.RECORD)).cache()
    s1, others = rows.where("entity_id like 'S1-%'"), rows.where("entity_id not like 'S1-%'")
    got = B.fuzzy_name_pairs(s1, others)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    a, b = (x.select(F.col("entity_id").alias(i), F.col("norm_name").alias(f"n{t}"), F.col("name_tokens").alias(f"t{t}")) for x, i, t in ((s1, B.PAIR[0], "a"), (others, B.PAIR[1], "b")))
    met = (F.substring("na", 1, 3) == F.substring("nb", 1, 3)) | F.arrays_overlap("ta", "tb")
    band = F.abs(F.length("na") - F.length("nb")) <= F.greatest(F.lit(1), F.floor(0.12 * F.length("na")))
    brute = a.crossJoin(b).where((F.length("na") >= 3) & (F.length("nb") >= 3) & met & band & S.lev_above("na", "nb")).select(*B.PAIR)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(x) for x in brute.collect()}
