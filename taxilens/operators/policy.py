"""Congestion-pricing marts.

2024-vs-2025 comparisons come from one scan with conditional aggregates
instead of a self-join of two per-year aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.frames import top_k
from ..functions.measures import measures
from .silver import years_filter

# Fixed labels: era names and the demand-change verdict (-5 % / 0 %).
ERA_LABELS = {0: "Pre (2024)", 1: "Post (2025)"}
TOTAL_LABELS = ("significant_reduction", "mild_reduction", "stable")


def congestion_monthly(silver: DataFrame, *, base: int = 2024, comp: int = 2025) -> DataFrame:
    """Month-by-month comparison with the base year's surcharge."""
    ib, ic = F.col("year") == base, F.col("year") == comp
    ms = measures(silver)
    m = (years_filter(silver, (base, comp)).groupBy("month")
         .agg(ms.n_if(ib).alias(f"trips_{base}"), ms.n_if(ic).alias(f"trips_{comp}"),
              ms.avg_if(ib, "fare_amount").alias("_fb"), ms.avg_if(ic, "fare_amount").alias("_fc"),
              ms.avg_if(ib, "congestion_fee").alias("_fee"))
         .where((F.col(f"trips_{base}") > 0) & (F.col(f"trips_{comp}") > 0)))
    return m.select(
        "month", f"trips_{base}", f"trips_{comp}",
        X.round_half_away(X.pct_change(f"trips_{comp}", f"trips_{base}"), 2).alias("trip_change_pct"),
        X.round_half_away("_fb", 2).alias(f"avg_fare_{base}"),
        X.round_half_away("_fc", 2).alias(f"avg_fare_{comp}"),
        X.round_half_away(F.col("_fc") - F.col("_fb"), 2).alias("fare_delta"),
        X.round_half_away("_fee", 2).alias("avg_congestion_fee"),
        F.make_date(F.lit(base), F.col("month"), F.lit(1)).alias("ds"),
    ).orderBy("month")


def pre_post(silver: DataFrame, *, years=(2024, 2025)) -> DataFrame:
    """Averages by policy era, with the era label."""
    label = F.when(F.col("is_congestion_era") == 0, F.lit(ERA_LABELS[0])) \
             .when(F.col("is_congestion_era") == 1, F.lit(ERA_LABELS[1]))
    m = measures(silver)
    return (years_filter(silver, years).groupBy("is_congestion_era")
            .agg(m.n().alias("total_trips"),
                 X.round_half_away(m.avg("fare_amount"), 2).alias("avg_fare"),
                 X.round_half_away(m.avg("fare_per_km"), 2).alias("avg_fare_per_km"),
                 X.round_half_away(m.avg("trip_distance"), 2).alias("avg_distance"),
                 X.round_half_away(m.avg("congestion_fee"), 4).alias("avg_congestion_fee"))
            .withColumn("era", label)
            .orderBy("is_congestion_era"))


def _zone_years(silver: DataFrame, base: int, comp: int, min_trips: int) -> DataFrame:
    ib, ic = F.col("year") == base, F.col("year") == comp
    m = measures(silver)
    return (years_filter(silver, (base, comp)).groupBy("pickup_zone")
            .agg(m.n_if(ib).alias("_nb"), m.n_if(ic).alias("_nc"),
                 m.avg_if(ib, "fare_amount").alias("_fb"), m.avg_if(ic, "fare_amount").alias("_fc"),
                 m.avg_if(ib, "congestion_fee").alias("_fee"))
            .where((F.col("_nb") >= min_trips) & (F.col("_nc") > 0))
            .withColumn("_mb", F.col("_nb") / F.lit(12.0))
            .withColumn("_mc", F.col("_nc") / F.lit(12.0)))


def impacted_zones(silver: DataFrame, *, base: int = 2024, comp: int = 2025,
                   min_trips: int = 1200, limit: int = 20) -> DataFrame:
    """Zones with the largest drop in average monthly trips (fixed /12)."""
    z = _zone_years(silver, base, comp, min_trips)
    out = z.select(
        "pickup_zone",
        X.round_half_away("_mb", 0).alias(f"avg_monthly_trips_{base}"),
        X.round_half_away("_mc", 0).alias(f"avg_monthly_trips_{comp}"),
        X.round_half_away(X.pct_change("_mc", "_mb"), 2).alias("avg_trip_change_pct"),
        X.round_half_away("_fb", 2).alias(f"avg_fare_{base}"),
        X.round_half_away("_fc", 2).alias(f"avg_fare_{comp}"),
        X.round_half_away(F.col("_fc") - F.col("_fb"), 2).alias("avg_fare_delta"),
        X.round_half_away("_fee", 2).alias("avg_congestion_fee"),
    )
    return top_k(out, limit, [F.col("avg_trip_change_pct").asc(), F.col("pickup_zone").asc()])


def benefited_zones(silver: DataFrame, *, base: int = 2024, comp: int = 2025,
                    min_trips: int = 1200, limit: int = 10) -> DataFrame:
    """Zones with the largest gain."""
    z = _zone_years(silver, base, comp, min_trips)
    out = z.select(
        "pickup_zone",
        X.round_half_away("_mb", 0).alias(f"avg_monthly_trips_{base}"),
        X.round_half_away("_mc", 0).alias(f"avg_monthly_trips_{comp}"),
        X.round_half_away(X.pct_change("_mc", "_mb"), 2).alias("avg_trip_change_pct"),
        X.round_half_away("_fc", 2).alias(f"avg_fare_{comp}"),
    )
    return top_k(out, limit, [F.col("avg_trip_change_pct").desc(), F.col("pickup_zone").asc()])


def congestion_totals(monthly: DataFrame, *, base: int = 2024, comp: int = 2025,
                      strong: float = -5.0) -> DataFrame:
    """Totals over the monthly mart and the verdict label.

    The fare change is a difference of unweighted means of the monthly
    *rounded* averages, exactly as the reference computes it.
    """
    t = monthly.agg(
        F.sum(f"trips_{base}").alias(f"total_trips_{base}"),
        F.sum(f"trips_{comp}").alias(f"total_trips_{comp}"),
        (F.avg(f"avg_fare_{comp}") - F.avg(f"avg_fare_{base}")).alias("avg_fare_change"),
    )
    t = t.withColumn("demand_change_pct",
                     X.growth_ratio_pct(f"total_trips_{comp}", f"total_trips_{base}"))
    return t.withColumn("label", X.change_label("demand_change_pct", strong, TOTAL_LABELS))
