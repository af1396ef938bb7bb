"""Rollup cells: merging parts, and refresh of a table landed step by step."""
import math
import os

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from taxilens.operators import silver
from taxilens.plans import registry as Q, rollup as RU
from taxilens.sources import catalog
from taxilens.streaming import ingest


def same(a, b, keys):
    """Two tables of cells, floats to 1e-9."""
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        for c in a[k].asDict():
            x, y = a[k][c], b[k][c]
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6), (k, c, x, y)


@pytest.mark.parametrize("kind", ["trips", "fares", "waits"])
def test_cells_of_parts_merge_into_those_of_the_whole(spark, kind):
    trips = (Q.fhv if kind == "waits" else Q.yellow)(spark, SF_SMALL)
    part = F.pmod(F.hash("pickup_time", "fare_amount"), F.lit(4))
    parts = None
    for k in range(4):
        one = RU.BUILD[kind](trips.where(part == k))
        parts = one if parts is None else parts.unionByName(one)
    same(RU.merge(kind, parts), RU.BUILD[kind](trips), RU.KEYS[kind])


def test_volatility_of_single_trips_is_null(spark):
    from taxilens.functions.measures import measures
    cells = RU.build_rollup(Q.yellow(spark, SF_SMALL).limit(1))
    assert cells.agg(measures(cells).stddev("fare_amount").alias("s")).first().s is None


@pytest.mark.parametrize("feed", ["yellow", "fhv"])
def test_refresh_reads_new_batches_only_and_replaces_old_ones(spark, tmp_root, feed):
    root = os.path.join(tmp_root, "refresh-" + feed)
    landing, raw, ck, cells = (f"{root}/{x}" for x in ("in", "raw", "ck", "cells"))
    trips = (Q.raw_yellow if feed == "yellow" else Q.raw_fhv)(spark, SF_SMALL)
    view = silver.silver_yellow if feed == "yellow" else silver.silver_fhv

    def check():
        whole = view(catalog.read_raw(spark, feed, raw), year_from_partition=True)
        for kind in RU.FEED_KINDS[feed]:
            same(RU.cells(spark, kind, cells), RU.BUILD[kind](whole), RU.KEYS[kind])

    for k, years in enumerate(((2022, 2023), (2024,), (2025, 2026))):
        trips.where(F.col("year").isin(*years)).drop("year").coalesce(1).write.mode("append").parquet(landing)
        ingest.land(spark, feed, landing, raw, ck)
        new = [f"landed-{k:08d}"]
        assert [r.batch for r in RU.pending(spark, raw, cells).collect()] == new
        opened = RU.new_trips(spark, feed, raw, new).inputFiles()
        assert opened and all(f"/batch={new[0]}/" in f for f in opened)
        assert RU.refresh(spark, feed, raw, cells) == new
        check()
    assert RU.refresh(spark, feed, raw, cells) == []

    # a corrected file is landed in the place of the batch that held the old one
    fixed = os.path.join(root, "fixed")
    trips.where("year = 2024 AND pulocationid < 20").drop("year").coalesce(1).write.parquet(fixed)
    path = next(os.path.join(fixed, f) for f in os.listdir(fixed) if f.endswith(".parquet"))
    ingest.land_files(spark, feed, [path], raw, "landed-00000001")
    assert RU.refresh(spark, feed, raw, cells) == ["landed-00000001"]
    check()

    # a run that stops before its log leaves nothing that is read
    ingest.land_files(spark, feed, [path], raw, "landed-00000001")
    RU.BUILD[RU.FEED_KINDS[feed][0]](RU.new_trips(spark, feed, raw, ["landed-00000001"]), by=("batch",)).write.partitionBy("batch").parquet(f"{cells}/{RU.FEED_KINDS[feed][0]}/run-lost")
    assert [r.batch for r in RU.pending(spark, raw, cells).collect()] == ["landed-00000001"]
    check()
