"""Every query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vaultframe.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(str, r)) for r in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(sql.sql(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
