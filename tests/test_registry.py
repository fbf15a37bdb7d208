"""The registered queries against their SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from tessella import queries as semantic

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return f"{float(v):.2f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", list(semantic.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = semantic.QUERIES[name](spark, SF)
    want = duck.sql(semantic.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want.fetchall()
    at = [want.columns.index(c) for c in columns]
    assert plain(got.select(*columns).collect()) == plain([[r[i] for i in at] for r in rows])


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
