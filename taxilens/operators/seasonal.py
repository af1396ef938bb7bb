"""Seasonal marts.

Each is aggregate -> window over a partition of the aggregate -> aggregate.
The windows partition by (year, zone), zone or year, so each window group
holds at most a few quarters/buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.frames import top_k
from ..functions.measures import measures
from .silver import years_filter

SEASON_YEARS = (2022, 2023, 2024, 2025)


def seasonal_by_quarter(silver: DataFrame, *, years=SEASON_YEARS) -> DataFrame:
    """Quarter index vs each zone's yearly average, averaged per quarter.

    ``avg_fare`` is the unweighted mean of the zone averages, as in the
    reference.
    """
    m = measures(silver)
    q = (years_filter(silver, years).groupBy("year", "quarter", "pickup_zone")
         .agg(m.n().alias("trip_count"), m.avg("fare_amount").alias("avg_fare")))
    w = Window.partitionBy("year", "pickup_zone")
    q = q.withColumn("seasonal_index", F.col("trip_count").cast("double") / F.avg("trip_count").over(w))
    return (q.groupBy("quarter")
            .agg(F.sum("trip_count").alias("total_trips"),
                 X.round_half_away(F.avg("avg_fare"), 2).alias("avg_fare"),
                 X.round_half_away(F.avg("seasonal_index"), 3).alias("avg_seasonal_index"),
                 F.countDistinct("pickup_zone").alias("zones"))
            .orderBy("quarter"))


def seasonal_zones(silver: DataFrame, *, years=SEASON_YEARS, min_trips: int = 4000,
                   limit: int = 20) -> DataFrame:
    """Zones whose quarterly index swings the most."""
    m = measures(silver)
    q = (years_filter(silver, years).groupBy("pickup_zone", "quarter")
         .agg(m.n().alias("trip_count"), m.avg("fare_amount").alias("avg_fare")))
    w = Window.partitionBy("pickup_zone")
    q = q.withColumn("seasonal_index", F.col("trip_count").cast("double") / F.avg("trip_count").over(w))
    z = (q.groupBy("pickup_zone")
         .agg(X.round_half_away(F.max("seasonal_index") - F.min("seasonal_index"), 3).alias("seasonal_range"),
              X.round_half_away(F.max("seasonal_index"), 3).alias("peak_index"),
              X.round_half_away(F.min("seasonal_index"), 3).alias("trough_index"),
              X.round_half_away(F.avg("avg_fare"), 2).alias("avg_fare"),
              F.sum("trip_count").alias("total_trips"))
         .where(F.col("total_trips") >= min_trips))
    return top_k(z, limit, [F.col("seasonal_range").desc(), F.col("pickup_zone").asc()])


def seasonal_q1_vs_q3(silver: DataFrame, *, years=SEASON_YEARS, min_trips: int = 2000,
                      limit: int = 20) -> DataFrame:
    """Winter vs summer per zone, ordered by the absolute change."""
    s = years_filter(silver, years).where(F.col("quarter").isin(1, 3))
    is1, is3 = F.col("quarter") == 1, F.col("quarter") == 3
    m = measures(silver)
    z = (s.groupBy("pickup_zone")
         .agg(m.n_if(is1).alias("trips_q1"), m.n_if(is3).alias("trips_q3"),
              m.avg_if(is1, "fare_amount").alias("_f1"), m.avg_if(is3, "fare_amount").alias("_f3"))
         .where((F.col("trips_q1") >= min_trips) & (F.col("trips_q3") > 0)))
    out = z.select(
        "pickup_zone", "trips_q1", "trips_q3",
        X.round_half_away(X.pct_change("trips_q3", "trips_q1"), 2).alias("summer_vs_winter_pct"),
        X.round_half_away("_f1", 2).alias("fare_q1"),
        X.round_half_away("_f3", 2).alias("fare_q3"),
    )
    return top_k(out, limit, [F.abs(F.col("summer_vs_winter_pct")).desc(), F.col("pickup_zone").asc()])


def seasonal_time_bucket(silver: DataFrame, *, years=SEASON_YEARS) -> DataFrame:
    """(year, quarter, bucket) trips and index vs the year's average cell.

    The reference groups a second time on the same keys; that is the
    identity, so it is not repeated.
    """
    m = measures(silver)
    b = (years_filter(silver, years).groupBy("year", "quarter", "time_bucket")
         .agg(m.n().alias("total_trips"), m.avg("fare_amount").alias("_fare")))
    w = Window.partitionBy("year")
    return b.select(
        "year", "quarter", "time_bucket", "total_trips",
        X.round_half_away("_fare", 2).alias("avg_fare"),
        X.round_half_away(F.col("total_trips").cast("double") / F.avg("total_trips").over(w), 3)
         .alias("seasonal_index"),
    ).orderBy("year", "quarter", "time_bucket")
