"""Candidates with a cap and their best by name, ranked by chunks: no pair of records is grouped or ranked."""

import re

import pytest
from test_met import made

from matchloom.operators import blocking as B


@pytest.mark.parametrize("cap", [3, 200])
def test_capped_equals_the_plain_way(spark, cap, monkeypatch):
    monkeypatch.setattr(B, "rare_tokens_predict", B.rare_tokens_train)  # tokens of more records
    s1, others = made(spark, copies=200)
    plain = B._capped_plain(s1, others, cap).cache()
    got = B.capped_candidates(s1, others, cap)
    assert not re.search(r"(Aggregate|Window) \[[^\]]*source1_entity_id#", got._jdf.queryExecution().optimizedPlan().toString())
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(x) for x in plain.collect()}
    best = {tuple(x) for x in B.name_top(plain, s1, others).collect()}
    top = [tuple(x) for x in B.capped_top(s1, others, cap=cap).collect()]
    assert len(top) == len(set(top)) and set(top) == best
