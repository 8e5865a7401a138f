"""Distances of many pairs at once equal Spark's."""

import random

import numpy as np
from pyspark.sql import functions as F

from matchloom.functions import edits


def test_distances_equal_sparks(spark):
    r = random.Random(4)
    text = lambda n, letters="abcé 1": "".join(r.choice(letters) for _ in range(n))
    left = ["", "a", "kitten", text(63), text(64), text(65), text(128), text(129), text(200), "日本語😀", *(text(r.randint(0, 150)) for _ in range(40))]
    right = ["", "b", "sitting", text(64), text(130), text(300), "日本😀", left[8][5:] + "xyz", *(t[:20] + text(3, "xyzab") + t[30:] for t in left)]
    i, j = (x.ravel() for x in np.indices((len(left), len(right))))
    got = edits.distances(left, right, i, j)
    rows = spark.createDataFrame([(int(p), left[x], right[y]) for p, (x, y) in enumerate(zip(i, j, strict=True))], "p int, a string, b string")
    want = {x.p: x.d for x in rows.select("p", F.levenshtein("a", "b").alias("d")).collect()}
    assert [want[p] for p in range(len(i))] == got.tolist()
    assert edits.distances([], [], np.zeros(0, int), np.zeros(0, int)).tolist() == []
