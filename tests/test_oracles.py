"""Every ledger query against its SQL oracle, by value, on the smallest tables."""

import os

import duckdb
import pytest

from ledgerframe.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, (bool, int)):
        return value
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF_DIR}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF_DIR)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    answer = duck.execute(sql)
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == names
    wanted = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in answer.fetchall()), key=repr)
    assert [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows] == [
        tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in wanted
    ]
