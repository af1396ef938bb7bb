"""Driver contract: every query runs on sf0.001 and agrees with its DuckDB oracle."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL
from taxilens.plans.registry import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (v or 0.0)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple(f"{x:.6g}" if isinstance(x, float) else repr(x) for x in t))


def _same(a, b):
    return len(a) == len(b) and all(
        math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float)
        else x == y for x, y in zip(a, b))


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.count() == 51
    assert df.columns == ["year", "month", "total_trips", "avg_fare", "total_revenue", "ds"]


def test_oracle_keys_are_queries():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert len(entry_mod.queries()) >= 75


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = entry_mod.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    a, b = _rows(df.columns, rows), _rows(dcols, res.fetchall())
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if not _same(x, y)]
    assert not bad, bad[:3]
