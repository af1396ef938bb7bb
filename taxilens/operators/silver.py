"""Silver layer: cleaned trip views over the raw feeds.

Each function is one ``select`` + one conjunctive ``where`` over the raw
DataFrame, so Catalyst pushes the validity bounds into the Parquet scan and
prunes the raw columns the view does not use.

``year`` follows the reference: it is derived from the pickup timestamp.  If
the raw table was landed by :func:`taxilens.streaming.ingest.land` its
``year`` partition column *is* that derived value, and callers may pass
``year_from_partition=True`` so year filters in the marts become partition
filters (exact, not approximate: the landing partitions by the pickup year).
"""

from __future__ import annotations

from collections.abc import Sequence

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

# Validity bounds and the study window of the reference.
FARE_BOUNDS = (2.5, 500.0)
DISTANCE_BOUNDS = (0.1, 100.0)
PASSENGER_BOUNDS = (1, 6)
WAIT_BOUNDS = (0, 60)
WINDOW = ("2022-01-01 00:00:00", "2026-04-01 00:00:00")
EXTENDED_WINDOW = ("2024-01-01 00:00:00", "2026-07-01 00:00:00")
EXTENDED_DURATION = (1, 180)


def _time_parts(ts: str, year_col) -> list:
    return [
        F.col(ts).alias("pickup_time"),
        year_col.alias("year"),
        F.month(ts).alias("month"),
        F.hour(ts).alias("pickup_hour"),
        F.quarter(ts).alias("quarter"),
        X.time_bucket(F.hour(ts)).alias("time_bucket"),
        X.era_flag(ts).alias("is_congestion_era"),
    ]


def _year(raw: DataFrame, ts: str, year_from_partition: bool):
    if year_from_partition and "year" in raw.columns:
        return F.col("year").cast("int")
    return F.year(ts)


def _window(start: str | None, end: str | None, extended: bool) -> tuple[str, str]:
    """The caller's bounds, each defaulting to the view's own."""
    lo, hi = EXTENDED_WINDOW if extended else WINDOW
    return start or lo, end or hi


def _in_window(raw: DataFrame, ts: str, start: str, end: str, year_from_partition: bool):
    """start <= ts < end; where the partition is the pickup year, also as a
    partition filter."""
    cond = (F.col(ts) >= X.ts_ntz(start)) & (F.col(ts) < X.ts_ntz(end))
    if year_from_partition and "year" in raw.columns:
        last = datetime.fromisoformat(end) - timedelta(microseconds=1)
        cond = F.col("year").between(datetime.fromisoformat(start).year, last.year) & cond
    return cond


def silver_yellow(raw: DataFrame, *, start: str | None = None, end: str | None = None,
                  extended: bool = False, year_from_partition: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``silver_yellow`` (13 columns), or the extended variant (P3) if asked.
    ``keep`` are raw columns that ride along before the 13."""
    ts, drop = "tpep_pickup_datetime", "tpep_dropoff_datetime"
    start, end = _window(start, end, extended)
    fare, dist = F.col("fare_amount"), F.col("trip_distance")
    passengers = F.col("passenger_count")
    cond = (fare.between(*FARE_BOUNDS)
            & dist.between(*DISTANCE_BOUNDS)
            & passengers.between(*PASSENGER_BOUNDS)
            & _in_window(raw, ts, start, end, year_from_partition)
            & (F.col(drop) > F.col(ts)))
    if extended:
        cond = cond & X.whole_minutes(ts, drop).between(*EXTENDED_DURATION)
    filtered = raw.where(cond)
    if not extended:
        return filtered.select(
            *keep, *_time_parts(ts, _year(raw, ts, year_from_partition)),
            F.col("pulocationid").alias("pickup_zone"),
            F.col("dolocationid").alias("dropoff_zone"),
            "fare_amount",
            "trip_distance",
            X.safe_ratio("fare_amount", "trip_distance").alias("fare_per_km"),
            F.coalesce(F.col("congestion_surcharge").cast("double"), F.lit(0.0)).alias("congestion_fee"),
        )
    return filtered.select(*_extended_columns(
        raw, ts, drop, "yellow", tip="tip_amount", passengers=F.col("passenger_count").cast("long"),
        wait=F.lit(None).cast("long"), plat=F.lit(None).cast("string"),
        year_from_partition=year_from_partition))


def silver_fhv(raw: DataFrame, *, start: str | None = None, end: str | None = None,
               extended: bool = False, year_from_partition: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``silver_fhv`` (15 columns), or the extended variant (P4) if asked.
    ``keep`` are raw columns that ride along before the 15.

    ``fare_amount`` is ``base_passenger_fare`` and ``trip_distance`` is
    ``trip_miles`` as in the reference; there is no passenger test.
    """
    ts, drop = "pickup_datetime", "dropoff_datetime"
    start, end = _window(start, end, extended)
    wait = X.whole_minutes("request_datetime", ts)
    cond = (F.col("base_passenger_fare").between(*FARE_BOUNDS)
            & F.col("trip_miles").between(*DISTANCE_BOUNDS)
            & _in_window(raw, ts, start, end, year_from_partition)
            & (F.col(drop) > F.col(ts))
            & wait.between(*WAIT_BOUNDS))
    if extended:
        cond = cond & X.whole_minutes(ts, drop).between(*EXTENDED_DURATION)
    filtered = raw.where(cond)
    if not extended:
        return filtered.select(
            *keep, *_time_parts(ts, _year(raw, ts, year_from_partition)),
            F.col("pulocationid").alias("pickup_zone"),
            F.col("dolocationid").alias("dropoff_zone"),
            F.col("base_passenger_fare").alias("fare_amount"),
            F.col("trip_miles").alias("trip_distance"),
            X.safe_ratio("base_passenger_fare", "trip_miles").alias("fare_per_km"),
            F.coalesce(F.col("congestion_surcharge").cast("double"), F.lit(0.0)).alias("congestion_fee"),
            wait.alias("wait_time_minutes"),
            X.platform("hvfhs_license_num").alias("platform"),
        )
    renamed = filtered.withColumnRenamed("base_passenger_fare", "fare_amount") \
                      .withColumnRenamed("trip_miles", "trip_distance")
    return renamed.select(*_extended_columns(
        renamed, ts, drop, "fhv", tip="tips", passengers=F.lit(1).cast("long"),
        wait=wait, plat=X.platform("hvfhs_license_num"),
        year_from_partition=year_from_partition))


def _extended_columns(raw, ts, drop, dataset, *, tip, passengers, wait, plat, year_from_partition):
    return [
        F.col(ts).alias("pickup_time"),
        F.col(drop).alias("dropoff_time"),
        _year(raw, ts, year_from_partition).alias("year"),
        F.month(ts).alias("month"),
        F.hour(ts).alias("pickup_hour"),
        X.iso_day_of_week(ts).alias("day_of_week"),
        F.quarter(ts).alias("quarter"),
        X.time_bucket(F.hour(ts)).alias("time_bucket"),
        X.era_flag(ts).alias("is_congestion_era"),
        F.lit(dataset).alias("dataset"),
        F.col("pulocationid").alias("pickup_zone"),
        F.col("dolocationid").alias("dropoff_zone"),
        F.col("fare_amount"),
        F.col(tip).alias("tip_amount"),
        F.col("trip_distance"),
        passengers.alias("passenger_count"),
        X.safe_ratio("fare_amount", "trip_distance").alias("fare_per_km"),
        F.coalesce(F.col("congestion_surcharge").cast("double"), F.lit(0.0)).alias("congestion_fee"),
        wait.alias("wait_time_minutes"),
        plat.alias("platform"),
    ]


def silver_extended_union(raw_yellow: DataFrame, raw_fhv: DataFrame, **kw) -> DataFrame:
    """Both extended views stacked; they share one schema (P3 + P4)."""
    return silver_yellow(raw_yellow, extended=True, **kw).unionByName(
        silver_fhv(raw_fhv, extended=True, **kw))


def years_filter(df: DataFrame, years) -> DataFrame:
    """``year IN (...)`` (F4); a partition filter when ``year`` is the partition column."""
    if years is None:
        return df
    return df.where(F.col("year").isin(list(years)))


def publish_views(raw_yellow: DataFrame, raw_fhv: DataFrame, **kw) -> None:
    """Register ``silver_yellow`` / ``silver_fhv`` as temporary views, so
    the marts can also be written as SQL text (``spark.sql``)."""
    silver_yellow(raw_yellow, **kw).createOrReplaceTempView("silver_yellow")
    silver_fhv(raw_fhv, **kw).createOrReplaceTempView("silver_fhv")
