"""Neighbours by cells: blocks of a cell meet, and no pair of vectors is a row."""

import numpy as np
from pyspark.sql import functions as F

from matchloom.operators import blocking as B


def test_blocks_of_cells(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(120, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[60:70] = x[50]  # copies: ties go to the smaller id
    rows = [(str(i), "ab"[i % 2], v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "entity_id string, country_norm string, embedding array<float>")
    s1, others = df.where("int(entity_id) % 3 = 0"), df.where("int(entity_id) % 3 <> 0")
    got = B.knn_pairs_ivf(s1, others, 5, 0.1, cells=(x[:6], 6))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and "aggregate(" not in plan
    want = B.knn_pairs(s1, others, 5, 0.1)
    of = lambda df: sorted(map(tuple, df.select(*B.PAIR, F.round("sim", 12)).collect()))
    assert of(got) == of(want)
