"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tesserae.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, db, name):
    frame = registry.queries()[name](spark, SF)
    rows = frame.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want


def test_flagship_runs(spark):
    assert registry.flagship(spark, SF).count() == 45
