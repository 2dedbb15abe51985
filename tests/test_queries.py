"""The registered queries over the derived graphs against SQL on another engine."""

import os

import pytest

from docloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders conversations documents pages".split()


def plain(v):
    return None if v is None or v != v else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    out = con.execute(ORACLES[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr(tuple(plain(v) for v in row)) for row in out.fetchall())
    rows = sorted(repr(tuple(plain(v) for v in row)) for row in got.select(*columns).collect())
    assert rows == want and rows


def test_entry_has_rows_and_survives_without_the_pipeline(spark, monkeypatch):
    import sys

    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 5
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)


def test_queries_without_sql_have_rows(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0
