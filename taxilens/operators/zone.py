"""Zone demand marts (A1-A7): zone performance, peak hours, supply gap,
fare elasticity, KPI summary, monthly stability and its correlations.

All marts first aggregate trips to a small key space (zone, hour, bucket,
month ...) with partial + final hash aggregation; every later step (windows,
top-k, pivots) runs on that aggregate, whose size is bounded by the zone and
calendar dimensions rather than by the trip count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.frames import attach_global, top_k
from ..functions.measures import is_rollup, measures
from .silver import years_filter

RECENT_YEARS = (2024, 2025, 2026)


def zone_performance(silver: DataFrame, *, years=RECENT_YEARS, limit: int = 20) -> DataFrame:
    """A1: per zone trips, fares and demand index vs the all-zone average."""
    m = measures(silver)
    z = (years_filter(silver, years).groupBy("pickup_zone")
         .agg(m.n().alias("total_trips"),
              m.avg("fare_amount").alias("_fare"),
              m.avg("fare_per_km").alias("_fpk")))
    z = attach_global(z, _avg_trips=F.avg("total_trips"))
    out = z.select(
        "pickup_zone", "total_trips",
        X.round_half_away("_fare", 2).alias("avg_fare"),
        X.round_half_away("_fpk", 2).alias("avg_fare_per_km"),
        (F.col("total_trips").cast("double") / F.col("_avg_trips")).alias("demand_index_vs_avg"),
    )
    return top_k(out, limit, [F.col("total_trips").desc(), F.col("pickup_zone").asc()])


def peak_hours(silver: DataFrame, *, years=RECENT_YEARS, top_zones: int = 10) -> DataFrame:
    """A2: hourly demand profile of the busiest zones.

    One scan: trips are aggregated to (zone, hour, bucket) once (at most
    zones x 24 rows).  Zone totals and the zone ranking are windows over
    that small aggregate, so the trips are never read a second time for the
    ranking.  The ranking window spans the whole aggregate, bounded by the
    zone and hour dimensions.
    """
    m = measures(silver)
    hourly = (years_filter(silver, years)
              .groupBy("pickup_zone", "pickup_hour", "time_bucket")
              .agg(m.n().alias("trip_count"), m.avg("fare_amount").alias("_fare")))
    hourly = hourly.withColumn("_zone_n", F.sum("trip_count").over(Window.partitionBy("pickup_zone")))
    rank = F.dense_rank().over(Window.partitionBy(F.lit(0))
                               .orderBy(F.col("_zone_n").desc(), F.col("pickup_zone").asc()))
    kept = hourly.withColumn("_rank", rank).where(F.col("_rank") <= top_zones)
    w = Window.partitionBy("pickup_zone")
    return kept.select(
        "pickup_zone", "pickup_hour", "time_bucket", "trip_count",
        X.round_half_away("_fare", 2).alias("avg_fare"),
        (F.col("trip_count").cast("double") / F.avg("trip_count").over(w)).alias("demand_index"),
    ).orderBy("pickup_zone", "pickup_hour", "time_bucket")


def supply_gap(silver: DataFrame, *, years=RECENT_YEARS, min_index: float = 1.2,
               limit: int = 20) -> DataFrame:
    """A3: zone x bucket demand index times fare volatility.

    Rounding order is the reference's: the index and volatility are rounded
    before they are multiplied.
    """
    m = measures(silver)
    base = (years_filter(silver, years).groupBy("pickup_zone", "time_bucket")
            .agg(m.n().alias("trip_count"),
                 X.round_half_away(m.avg("fare_amount"), 2).alias("avg_fare"),
                 X.round_half_away(m.stddev("fare_amount"), 2).alias("fare_volatility")))
    w = Window.partitionBy("pickup_zone")
    idx = base.withColumn(
        "demand_index",
        X.round_half_away(F.col("trip_count").cast("double") / F.avg("trip_count").over(w), 3))
    out = idx.where(F.col("demand_index") > F.lit(float(min_index))).select(
        "pickup_zone", "time_bucket", "demand_index", "avg_fare", "fare_volatility",
        F.col("trip_count").alias("total_trips"),
        X.round_half_away(F.col("demand_index") * F.col("fare_volatility"), 3).alias("supply_gap_score"),
    )
    return top_k(out, limit, [F.col("supply_gap_score").desc_nulls_last(),
                              F.col("pickup_zone").asc(), F.col("time_bucket").asc()])


def elasticity(silver: DataFrame, *, years=RECENT_YEARS, bucket_width: float = 5.0,
               min_trips: int = 30) -> DataFrame:
    """A4: demand per fare bucket and its change vs the previous surviving
    bucket, from trips or from fare cells of the same width (``rollup.fares``)."""
    m = measures(silver)
    rows = years_filter(silver, years)
    if not is_rollup(silver):
        rows = rows.withColumn("fare_bucket", X.bucket_floor("fare_amount", bucket_width))
    fb = (rows.groupBy("pickup_zone", "time_bucket", "fare_bucket")
          .agg(m.n().alias("trip_count"),
               m.avg("fare_amount").alias("_fare"),
               m.avg("trip_distance").alias("_dist"))
          .where(F.col("trip_count") >= min_trips))
    w = Window.partitionBy("pickup_zone", "time_bucket").orderBy("fare_bucket")
    prev = F.lag("trip_count").over(w)
    return fb.select(
        "pickup_zone", "time_bucket", "fare_bucket", "trip_count",
        X.round_half_away("_fare", 2).alias("avg_fare"),
        X.round_half_away("_dist", 2).alias("avg_distance"),
        X.round_half_away(X.pct_change("trip_count", prev), 2).alias("pct_demand_change"),
    ).orderBy("pickup_zone", "time_bucket", "fare_bucket")


def kpi_summary(silver: DataFrame, *, years=RECENT_YEARS) -> DataFrame:
    """A5: one-row headline numbers."""
    m = measures(silver)
    return years_filter(silver, years).agg(
        F.countDistinct("pickup_zone").alias("total_zones"),
        m.n().alias("total_trips"),
        X.round_half_away(m.avg("fare_amount"), 2).alias("overall_avg_fare"),
        X.round_half_away(m.avg("fare_per_km"), 2).alias("overall_fare_per_km"),
        X.round_half_away(m.min("fare_amount"), 2).alias("min_fare"),
        X.round_half_away(m.max("fare_amount"), 2).alias("max_fare"),
    )


def monthly_stability(silver: DataFrame, *, year: int = 2024, months=(1, 6),
                      min_trips: int = 100) -> DataFrame:
    """Month x zone averages for the first half of ``year``."""
    m = measures(silver)
    return (silver.where((F.col("year") == year) & F.col("month").between(*months))
            .groupBy("month", "pickup_zone")
            .agg(m.avg("fare_amount").alias("avg_fare"),
                 m.avg("fare_per_km").alias("avg_fare_per_km"),
                 m.n().alias("trip_count"))
            .where(F.col("trip_count") >= min_trips))


# Month pairs compared by the stability check; the first three are computed
# on zones present in months 1, 2 and 3, the rest on zones present in both.
STABILITY_PAIRS = (
    ("jan_feb", 1, 2, True), ("feb_mar", 2, 3, True), ("jan_mar", 1, 3, True),
    ("jan_apr", 1, 4, False), ("jan_may", 1, 5, False), ("jan_jun", 1, 6, False),
)


def stability_correlation(monthly: DataFrame, *, threshold: float = 0.95) -> DataFrame:
    """Pearson correlation of zone fares and volumes between months.

    The month x zone table is pivoted by conditional aggregation (one row
    per zone), the pairs are stacked with ``explode`` and ``corr`` runs as an
    ordinary grouped aggregate, so no pair list is materialised anywhere.
    """
    months = sorted({m for _, a, b, _ in STABILITY_PAIRS for m in (a, b)})
    aggs = []
    for m in months:
        aggs.append(F.max(F.when(F.col("month") == m, F.col("avg_fare"))).alias(f"f{m}"))
        aggs.append(F.max(F.when(F.col("month") == m, F.col("trip_count").cast("double"))).alias(f"n{m}"))
    wide = monthly.groupBy("pickup_zone").agg(*aggs)
    in_q1 = F.col("f1").isNotNull() & F.col("f2").isNotNull() & F.col("f3").isNotNull()
    entries = []
    for name, a, b, needs_q1 in STABILITY_PAIRS:
        keep = (in_q1 if needs_q1 else F.lit(True)) & F.col(f"f{a}").isNotNull() & F.col(f"f{b}").isNotNull()
        for metric, p in (("avg_fare", "f"), ("trip_count", "n")):
            entries.append(F.struct(
                F.lit(name).alias("comparison"), F.lit(metric).alias("metric"),
                keep.alias("keep"), F.col(f"{p}{a}").alias("x"), F.col(f"{p}{b}").alias("y")))
    long = wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("keep")
    return (long.groupBy("comparison", "metric")
            .agg(F.count(F.lit(1)).alias("zones"), pearson("x", "y").alias("correlation"))
            .withColumn("above_threshold",
                        F.coalesce(F.col("correlation") > F.lit(float(threshold)), F.lit(False))))


def pearson(x: str, y: str):
    """Pearson r that is NULL (not an ANSI division error) for fewer than two
    points or a constant side, like pandas' NaN."""
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(den == 0, F.lit(None)).otherwise(den)


def stability_verdict(corr: DataFrame) -> DataFrame:
    """Fare/volume stable when Jan-Feb and Jan-Mar both exceed the threshold."""
    core = F.col("comparison").isin("jan_feb", "jan_mar")
    return corr.agg(
        F.coalesce(F.min(F.when(core & (F.col("metric") == "avg_fare"), F.col("above_threshold"))),
                   F.lit(False)).alias("fare_stable"),
        F.coalesce(F.min(F.when(core & (F.col("metric") == "trip_count"), F.col("above_threshold"))),
                   F.lit(False)).alias("volume_stable"),
    )
