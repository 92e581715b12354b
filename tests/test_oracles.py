"""Every query with SQL, against that SQL, on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from gridloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return connection


def plain(rows, columns):
    def value(v):
        number = isinstance(v, int | float | Decimal) and not isinstance(v, bool)
        return repr(round(float(v), 5) + 0.0) if number else repr(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([value(r[k]) for k in order] for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_like_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
