"""Event-time windows with a watermark: late rows, state, restart."""
import datetime
import os

import pytest
from pyspark.sql import functions as F
from taxilens.streaming import live

SCHEMA = "ts timestamp, kind string, value double"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour, minutes=minute)


BATCHES = [
    [(at(0, 5), "a", 1.0), (at(1, 5), "a", 2.0), (at(1, 10), "b", 3.0)],
    [(at(6), "a", 4.0), (at(0, 50), "a", 5.0)],        # an hour back: no batch has told a watermark yet
    [(at(12), "b", 6.0), (at(1, 30), "a", 7.0)],       # the watermark of batch 1 is at 23:05 the day before
    [(at(20), "a", 8.0), (at(1, 40), "a", 9.0), (at(11), "b", 10.0)],  # .. of batch 2 at 4:00: one late row
    [(at(30), "b", 11.0), (at(6, 30), "a", 12.0)],     # .. of batch 3 at 10:00: one late row
]


def land(spark, landing, batches):
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(landing)


def windows(spark, root):
    out = live.closed(spark, f"{root}/out", live.demand(spark.createDataFrame([], SCHEMA), keys=["kind"], every="1 hour").schema)
    return sorted((r.start, r.kind, r.events, r.value_sum) for r in out.collect())


def expected():
    rows = [x for k, b in enumerate(BATCHES) for x in b if (k, x[0]) not in {(3, at(1, 40)), (4, at(6, 30))}]
    out = {}
    for ts, kind, value in rows:
        start = ts.replace(minute=0)
        if start + datetime.timedelta(hours=1) <= at(28):  # 30:00 less the delay
            n, s = out.get((start, kind), (0, 0.0))
            out[start, kind] = n + 1, s + value
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("stops", [(5,), (1, 2, 3, 4, 5), (2, 2, 5)])
def test_windows_whatever_the_restarts(spark, tmp_root, stops):
    """One run, a run per batch, and a run that finds nothing new give the same windows."""
    root = os.path.join(tmp_root, "live-" + "-".join(map(str, stops)))
    done = 0
    for stop in stops:
        land(spark, f"{root}/in", BATCHES[done:stop])
        done = stop
        live.run(spark, f"{root}/in", SCHEMA, f"{root}/out", f"{root}/ck", keys=["kind"], every="1 hour", delay="2 hours")
    got = windows(spark, root)
    assert len({(s, k) for s, k, _, _ in got}) == len(got)  # no window twice
    if stops == (5,):
        assert got == expected()
    else:  # a run of its own ends with an empty batch, so the watermark is one batch further
        assert {x[:2] for x in got} == {x[:2] for x in expected()}
        assert sum(x[2] for x in got) <= sum(x[2] for x in expected())


def test_late_rows_are_counted(spark):
    rows = [(k, *x) for k, b in enumerate(BATCHES) for x in b]
    df = spark.createDataFrame(rows, "batch int, " + SCHEMA)
    got = {r.batch: (r.rows, r.late) for r in live.late_rows(df, every="1 hour", delay="2 hours").collect()}
    assert got == {0: (3, 0), 1: (2, 0), 2: (2, 0), 3: (3, 1), 4: (2, 1)}


def test_batch_marts_of_closed_windows(spark):
    rows = [(at(h), "a", 2, 3.0) for h in (1, 25, 2)] + [(at(1), "b", 1, 0.0)]
    w = spark.createDataFrame(rows, "start timestamp, kind string, events long, value_sum double")
    peak = {(r.kind, r.hour): (r.events, r.avg_value, r.demand_index) for r in live.peak_hours(w, key="kind").collect()}
    assert peak == {("a", 1): (4, 1.5, pytest.approx(4 / 3)), ("a", 2): (2, 1.5, pytest.approx(2 / 3)), ("b", 1): (1, 0.0, 1.0)}
    assert sorted((str(r.day), r.events) for r in live.trend(w).collect()) == [("2024-01-01", 5), ("2024-01-02", 2)]
    assert live.trend(w.where(F.lit(False))).count() == 0


def test_landing_reads_its_rows_once_and_makes_a_file_a_batch(spark, tmp_root):
    root = os.path.join(tmp_root, "live-land")
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    rows = [(at(k, m), "a", float(m), k) for m in range(20) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA + ", batch int").repartition(3)
    live.land(df.mapInPandas(counted, df.schema), f"{root}/arrivals", f"{root}/in")
    assert read.value == len(rows)
    files = sorted((f for f in os.scandir(f"{root}/in") if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime)
    got = [{r.ts.hour for r in spark.read.parquet(f.path).collect()} for f in files]
    assert got == [{k} for k in range(5)]
    assert spark.read.parquet(f"{root}/in").count() == len(rows)


def test_state_has_a_part_a_core_at_most(spark, tmp_root):
    root = os.path.join(tmp_root, "live-parts")
    land(spark, f"{root}/in", BATCHES[:2])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        live.run(spark, f"{root}/in", SCHEMA, f"{root}/out", f"{root}/ck", keys=["kind"], every="1 hour", delay="2 hours")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in os.listdir(f"{root}/ck/state/0") if p.isdigit()]) == min(40, spark.sparkContext.defaultParallelism)
