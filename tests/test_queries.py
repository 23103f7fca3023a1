"""Every registered query with SQL gives the rows that DuckDB gives; the others give some rows."""

import math
import os

import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.QUERIES)


def _same(a, b) -> bool:
    if a is None or b is None:
        return (a is None or a != a) and (b is None or b != b)
    if isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-2) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.SQL])
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    result = duck.sql(registry.SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    wanted = [tuple(r[i] for i in at) for r in result.fetchall()]
    order = lambda r: tuple((x is None, str(x) if not isinstance(x, float) else f"{x:020.3f}") for x in r)
    found, wanted = sorted(found, key=order), sorted(wanted, key=order)
    assert len(found) == len(wanted)
    bad = [(a, b) for a, b in zip(found, wanted) if not all(map(_same, a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", [n for n in NAMES if n not in registry.SQL])
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 5 and all(r["rmse"] > 0 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
