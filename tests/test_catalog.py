import math
import os

import duckdb
import pytest

from warraq.plans import catalog

ORACLE = catalog.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if hasattr(v, "quantize") else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in os.listdir(sf):
        c.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    if name in ORACLE:
        r = con.execute(ORACLE[name])
        cols = [c[0] for c in r.description]
        assert sorted(cols) == sorted(df.columns)
        order = sorted(cols)
        want = sorted((tuple(norm(x[cols.index(c)]) for c in order) for x in r.fetchall()), key=repr)
        assert sorted((tuple(norm(x[c]) for c in order) for x in rows), key=repr) == want
    else:
        assert df.columns


def test_oracles_have_queries():
    assert set(ORACLE) <= set(catalog.queries())
