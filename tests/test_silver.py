"""Boundary rows of FIXTURES.md §4 through the silver views."""
import datetime as dt

from pyspark.sql import Row

from taxilens.operators import silver
from taxilens.schemas import FHV_SCHEMA, YELLOW_SCHEMA

BASE = dt.datetime(2024, 3, 5, 12, 0, 0)


def yrow(**kw):
    d = dict(tpep_pickup_datetime=BASE, tpep_dropoff_datetime=BASE + dt.timedelta(minutes=10),
             pulocationid=1, dolocationid=2, fare_amount=10.0, tip_amount=1.0, trip_distance=2.0,
             passenger_count=1, congestion_surcharge=2.5, year=2024)
    d.update(kw)
    return Row(**d)


def run_yellow(spark, rows):
    df = spark.createDataFrame([tuple(r[f.name] for f in YELLOW_SCHEMA.fields) for r in rows], YELLOW_SCHEMA)
    return silver.silver_yellow(df).orderBy("fare_amount", "trip_distance").collect()


def test_fare_bounds(spark):
    out = run_yellow(spark, [yrow(fare_amount=v) for v in (2.5, 500.0, 2.49, 500.01)])
    assert sorted(r.fare_amount for r in out) == [2.5, 500.0]


def test_distance_bounds_and_safe_ratio(spark):
    out = run_yellow(spark, [yrow(trip_distance=v) for v in (0.1, 100.0, 0.0)])
    assert sorted(r.trip_distance for r in out) == [0.1, 100.0]
    assert all(r.fare_per_km == r.fare_amount / r.trip_distance for r in out)


def test_passenger_bounds_and_null(spark):
    out = run_yellow(spark, [yrow(passenger_count=v, fare_amount=10.0 + i)
                             for i, v in enumerate((1, 6, 0, 7, None))])
    assert sorted(r.fare_amount for r in out) == [10.0, 11.0]


def test_window_half_open(spark):
    ts = [dt.datetime(2022, 1, 1), dt.datetime(2026, 3, 31, 23, 59, 59), dt.datetime(2026, 4, 1)]
    out = run_yellow(spark, [yrow(tpep_pickup_datetime=t, tpep_dropoff_datetime=t + dt.timedelta(minutes=5),
                                  fare_amount=10.0 + i) for i, t in enumerate(ts)])
    assert len(out) == 2


def test_dropoff_must_follow_pickup(spark):
    out = run_yellow(spark, [yrow(tpep_dropoff_datetime=BASE)])
    assert out == []


def test_time_buckets(spark):
    hours = [0, 5, 6, 7, 9, 10, 16, 17, 19, 20]
    rows = [yrow(tpep_pickup_datetime=BASE.replace(hour=h), tpep_dropoff_datetime=BASE.replace(hour=h, minute=30),
                 fare_amount=10.0 + h) for h in hours]
    out = run_yellow(spark, rows)
    got = [r.time_bucket for r in sorted(out, key=lambda r: r.pickup_hour)]
    assert got == ["late_night", "late_night", "off_peak", "morning_rush", "morning_rush",
                   "off_peak", "off_peak", "evening_rush", "evening_rush", "off_peak"]


def test_congestion_era_flag_and_fee_default(spark):
    a = dt.datetime(2025, 1, 4, 23, 59, 59)
    b = dt.datetime(2025, 1, 5, 0, 0, 0)
    out = run_yellow(spark, [
        yrow(tpep_pickup_datetime=a, tpep_dropoff_datetime=a + dt.timedelta(minutes=3), fare_amount=10.0,
             congestion_surcharge=None, year=2025),
        yrow(tpep_pickup_datetime=b, tpep_dropoff_datetime=b + dt.timedelta(minutes=3), fare_amount=11.0, year=2025)])
    assert [r.is_congestion_era for r in out] == [0, 1]
    assert out[0].congestion_fee == 0.0


def frow(request_offset_s, fare=10.0, licence="HV0003"):
    pickup = BASE
    d = dict(hvfhs_license_num=licence, request_datetime=pickup - dt.timedelta(seconds=request_offset_s),
             on_scene_datetime=pickup, pickup_datetime=pickup, dropoff_datetime=pickup + dt.timedelta(minutes=9),
             pulocationid=3, dolocationid=4, trip_miles=2.0, trip_time=540, base_passenger_fare=fare,
             tolls=0.0, congestion_surcharge=None, tips=0.0, driver_pay=5.0, shared_request_flag="N",
             shared_match_flag="N", year=2024)
    return tuple(d[f.name] for f in FHV_SCHEMA.fields)


def test_wait_truncation_and_bounds(spark):
    # request 30 s after pickup; 59 s before; 60 min 59 s before; 61 min before
    rows = [frow(-30, 10.0), frow(59, 11.0), frow(3659, 12.0), frow(3660, 13.0)]
    df = spark.createDataFrame(rows, FHV_SCHEMA)
    out = silver.silver_fhv(df).orderBy("fare_amount").collect()
    assert [(r.fare_amount, r.wait_time_minutes) for r in out] == [(10.0, 0), (11.0, 0), (12.0, 60)]


def test_platform_decode(spark):
    rows = [frow(120, 10.0, "HV0003"), frow(120, 11.0, "HV0005"), frow(120, 12.0, "HV0004")]
    out = silver.silver_fhv(spark.createDataFrame(rows, FHV_SCHEMA)).orderBy("fare_amount").collect()
    assert [r.platform for r in out] == ["Uber", "Lyft", "Other"]


def test_extended_union_shares_schema(spark):
    from taxilens.plans.registry import raw_fhv, raw_yellow
    from conftest import SF_SMALL
    u = silver.silver_extended_union(raw_yellow(spark, SF_SMALL), raw_fhv(spark, SF_SMALL))
    assert set(u.select("dataset").distinct().toPandas()["dataset"]) == {"yellow", "fhv"}
    r = u.where("dataset = 'fhv'").select("passenger_count").distinct().collect()
    assert [x.passenger_count for x in r] == [1]


def _silver_rows(spark, rows):
    schema = ("pickup_time timestamp_ntz, year int, month int, pickup_hour int, quarter int, time_bucket string, "
              "is_congestion_era int, pickup_zone int, dropoff_zone int, fare_amount double, trip_distance double, "
              "fare_per_km double, congestion_fee double")
    return spark.createDataFrame(rows, schema)


def test_elasticity_lag_skips_filtered_bucket(spark):
    from taxilens.operators import zone
    t = dt.datetime(2024, 5, 1, 12)
    rows = []
    # buckets 10 (3 trips), 15 (3 trips), 20 (1 trip: below the minimum), 25 (6 trips)
    for fare, k in ((11.0, 3), (16.0, 3), (21.0, 1), (26.0, 6)):
        rows += [(t, 2024, 5, 12, 2, "off_peak", 0, 7, 8, fare, 2.0, fare / 2.0, 0.0)] * k
    out = zone.elasticity(_silver_rows(spark, rows), min_trips=2).collect()
    assert [r.fare_bucket for r in out] == [10.0, 15.0, 25.0]
    assert out[2].pct_demand_change == 100.0      # 6 vs 3 (bucket 15), not vs bucket 20


def test_top_k_ties_break_on_lower_zone(spark):
    from taxilens.operators import zone
    t = dt.datetime(2024, 5, 1, 12)
    rows = [(t, 2024, 5, 12, 2, "off_peak", 0, z, 1, 10.0, 2.0, 5.0, 0.0) for z in (9, 3, 5) for _ in range(4)]
    out = zone.zone_performance(_silver_rows(spark, rows), limit=2).collect()
    assert [r.pickup_zone for r in out] == [3, 5]
    assert all(r.demand_index_vs_avg == 1.0 for r in out)
