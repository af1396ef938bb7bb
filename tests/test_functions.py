"""Rounding and distribution helpers against DuckDB, numpy and table values."""
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from taxilens.functions import dist
from taxilens.functions import exprs as X

VALUES = [1.005, 2.675, 0.125, -1.005, 0.285, 1.115, 2.5, 3.5, -2.5, 1234.5678, 0.0, 1e-9, 123456.785]


def test_round_half_away_matches_duckdb(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    got = {d: [r[0] for r in df.select(X.round_half_away("x", d)).collect()] for d in (0, 2, 3)}
    for d in (0, 2, 3):
        want = [duckdb.sql(f"SELECT round({v}::DOUBLE, {d})").fetchall()[0][0] for v in VALUES]
        assert got[d] == want


def test_round_half_even_matches_numpy(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    for d in (0, 2, 4):
        got = [r[0] for r in df.select(X.round_half_even("x", d)).collect()]
        assert got == [float(np.round(v, d)) for v in VALUES]


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.0733880347), (1.0, 1, 0.5), (2.228138852, 10, 0.05),
                                    (0.0, 5, 1.0), (3.0, 100, 0.0034079153), (-2.0, 10, 0.0733880347)])
def test_t_two_sided(t, df, p):
    assert dist.t_two_sided_scalar(t, df) == pytest.approx(p, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("q,df,x", [(0.975, 10, 2.228138852), (0.975, 1, 12.70620474), (0.95, 30, 1.697260887),
                                    (0.5, 7, 0.0), (0.025, 10, -2.228138852)])
def test_t_ppf(q, df, x):
    assert dist.t_ppf_scalar(q, df) == pytest.approx(x, rel=1e-8, abs=1e-10)


def test_normal():
    assert float(dist.norm_two_sided(1.959963984540054)) == pytest.approx(0.05, rel=1e-12)
    assert float(dist.norm_sf(0.0)) == 0.5


def test_pandas_udfs(spark):
    df = spark.createDataFrame([(2.0, 10.0), (1.0, 1.0)], "t double, df double")
    got = [r[0] for r in df.select(dist.t_two_sided_p("t", "df")).collect()]
    assert got[0] == pytest.approx(0.0733880347, rel=1e-6) and got[1] == pytest.approx(0.5, rel=1e-9)
    got = [r[0] for r in df.select(dist.t_ppf(F.lit(0.975), "df")).collect()]
    assert got[0] == pytest.approx(2.228138852, rel=1e-8)


def test_time_bucket_expression(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    b = {r.h: r.b for r in df.select("h", X.time_bucket("h").alias("b")).collect()}
    assert b[6] == "off_peak" and b[7] == "morning_rush" and b[5] == "late_night" and b[19] == "evening_rush"
    assert sum(1 for v in b.values() if v == "off_peak") == 24 - 3 - 3 - 6


def test_pct_change_null_on_zero(spark):
    df = spark.createDataFrame([(5.0, 0.0), (15.0, 10.0)], "n double, b double")
    got = [r[0] for r in df.select(X.pct_change("n", "b")).collect()]
    assert got == [None, 50.0]
