"""The queries that SQL can express, against DuckDB."""

import math
import os

import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = duck.sql(queries.SQL[name])
    at = [result.columns.index(c) for c in columns]
    wanted = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert all(math.isclose(x, y, rel_tol=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
