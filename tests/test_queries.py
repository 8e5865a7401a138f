"""Every catalogued query against its DuckDB counterpart."""

import duckdb
import pytest

from matchloom.plans import catalogue


def comparable(rows):
    return sorted(tuple(repr(round(float(x), 5)) if isinstance(x, float) or type(x).__name__ == "Decimal" else repr(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    want = duck.sql(f"select {', '.join(cols)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert comparable(got) == comparable(want)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_group_split_parts(spark, sf):
    rows = catalogue.QUERIES["group_split"](spark, sf).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.source1_entity_id, set()).add(r.trains)
    assert rows and all(len(s) == 1 for s in sides.values()) and {True} in sides.values() and {False} in sides.values()
