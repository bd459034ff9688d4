"""Every registered query of the library proper against its SQL in DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from heedstream import registry


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (bool, int, float, decimal.Decimal)):
        return round(float(x), 9) + 0.0
    return str(x)[:26].replace(" 00:00:00", "")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    columns = sorted(df.columns)
    if name not in registry.ORACLES:
        assert rows
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)
