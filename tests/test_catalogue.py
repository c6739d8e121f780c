"""Every general query against its SQL."""

import decimal

import duckdb
import pytest

from gaugework.plans.catalogue import ORACLES, QUERIES
from gaugework.plans.views import RAW

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else round(float(v), 5) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in RAW:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = want.project(",".join(f'"{c}"' for c in columns)).fetchall()
    assert got == sorted((tuple(plain(x) for x in r) for r in rows), key=repr)
