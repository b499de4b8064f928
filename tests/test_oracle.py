"""Every query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from vellum.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str):
        return v
    v = float(v)
    return float(f"{v:.12g}")


def rows(names, found):
    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    found = [r.asDict() for r in df.collect()]
    assert found
    if name in catalog.oracle_sql():
        cur = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(sorted(names), found) == rows(sorted(names), [dict(zip(names, r, strict=True)) for r in cur.fetchall()])
