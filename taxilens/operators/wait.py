"""FHV wait-time marts.

Percentiles are exact.  Wait times are whole minutes bounded to [1, 60], so
trips are first counted per group and minute in a plain hash aggregate, at
most 60 rows per group however many trips it holds; ``percentile`` with
those counts as frequencies then reads the counts, never the trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .silver import years_filter

WAIT_YEARS = (2022, 2023, 2024, 2025, 2026)
WAIT_KEYS = ("year", "pickup_zone", "time_bucket", "platform")


def fhv_wait_time(silver_fhv: DataFrame, *, years=WAIT_YEARS, bounds=(1, 60),
                  min_trips: int = 100) -> DataFrame:
    """Wait statistics per (year, zone, bucket, platform) and an action,
    from trips or from counts of minutes (``rollup.waits``, with a column n)."""
    w = F.col("wait_time_minutes")
    count = F.sum("n") if "n" in silver_fhv.columns else F.count(F.lit(1))
    minutes = (years_filter(silver_fhv, years).where(w.between(*bounds))
               .groupBy(*WAIT_KEYS, "wait_time_minutes").agg(count.alias("_n")))
    n = F.sum("_n")
    g = (minutes.groupBy(*WAIT_KEYS)
         .agg(n.alias("total_trips"),
              (F.sum(w * F.col("_n")) / n).alias("_avg"),
              F.percentile(w, 0.5, F.col("_n")).alias("median_wait_min"),
              F.percentile(w, 0.9, F.col("_n")).alias("p90_wait_min"))
         .where(F.col("total_trips") >= min_trips))
    return g.select(
        *WAIT_KEYS, "total_trips",
        X.round_half_away("_avg", 2).alias("avg_wait_min"),
        X.round_half_away("median_wait_min", 2).alias("median_wait_min"),
        X.round_half_away("p90_wait_min", 2).alias("p90_wait_min"),
        X.wait_action("_avg").alias("action"),
    ).orderBy(F.col("avg_wait_min").desc(), *WAIT_KEYS)


def wait_by(wait_mart: DataFrame, key: str) -> DataFrame:
    """Unweighted mean of the rounded group averages, per ``key``."""
    return (wait_mart.groupBy(key)
            .agg(X.round_half_even(F.avg("avg_wait_min"), 2).alias("avg_wait_min"))
            .orderBy(key))
