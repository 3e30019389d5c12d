"""The queries that SQL can express against their SQL."""

import os

import duckdb
import pytest

from tesserae.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(repr([r[c] for c in sorted(names)]) for r in frame.collect()) == sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in result.fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
