"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from callweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in order) for r in data))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    fn, sql = QUERIES[name]
    found = fn(spark, SF)
    data = [tuple(r) for r in found.collect()]
    assert data
    if sql:
        expected = oracle.execute(sql)
        columns = [d[0] for d in expected.description]
        assert sorted(found.columns) == sorted(columns)
        assert rows(found.columns, data) == rows(columns, expected.fetchall())
