"""Every core query against its SQL on the small tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    key = lambda v: (v is not None, round(v, 6) + 0.0 if isinstance(v, float) else v if v is not None else "")
    return sorted(tuple(key(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    d = catalog.queries()[name](spark, SF)
    r = duck.execute(SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(d.columns) == sorted(columns)
    assert plain([tuple(x) for x in d.collect()], d.columns) == plain(r.fetchall(), columns)
