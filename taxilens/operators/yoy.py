"""Year-over-year marts.

The reference compares years with self-joins of two per-year aggregates;
here both sides come from one scan with conditional aggregates
(``count/avg ... FILTER (year = y)``), and the join's inner semantics become
"both counts > 0".  Year-to-year growth uses ``lag`` over the yearly table,
which has one row per requested year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.frames import top_k
from ..functions.measures import measures
from .silver import years_filter

FULL_YEARS = (2022, 2023, 2024, 2025)
ALL_YEARS = (2022, 2023, 2024, 2025, 2026)

# Fixed labels of the Q1 snapshot (thresholds -5 % and 0 %).
Q1_LABELS = ("significant_decline", "mild_decline", "stable_or_growing")


def yoy_summary(silver: DataFrame, *, years=FULL_YEARS) -> DataFrame:
    """Yearly totals plus growth; fare growth is on the *rounded* fare."""
    m = measures(silver)
    y = (years_filter(silver, years).groupBy("year")
         .agg(m.n().alias("total_trips"),
              X.round_half_away(m.avg("fare_amount"), 2).alias("avg_fare"),
              X.round_half_away(m.avg("fare_per_km"), 2).alias("avg_fare_per_km"),
              X.round_half_away(m.sum("fare_amount"), 0).alias("total_revenue"),
              F.countDistinct("pickup_zone").alias("active_zones")))
    # One row per requested year: the ordered window is over a handful of rows.
    w = Window.partitionBy(F.lit(0)).orderBy("year")
    return y.select(
        "*",
        X.round_half_even(X.growth_ratio_pct("total_trips", F.lag("total_trips").over(w)), 2)
         .alias("trip_growth_pct"),
        X.round_half_even(X.growth_ratio_pct("avg_fare", F.lag("avg_fare").over(w)), 2)
         .alias("fare_growth_pct"),
    ).orderBy("year")


def _two_years(silver: DataFrame, base: int, comp: int, with_fares: bool) -> DataFrame:
    is_b, is_c = F.col("year") == base, F.col("year") == comp
    m = measures(silver)
    aggs = [m.n_if(is_b).alias("_nb"), m.n_if(is_c).alias("_nc")]
    if with_fares:
        aggs += [m.avg_if(is_b, "fare_amount").alias("_fb"), m.avg_if(is_c, "fare_amount").alias("_fc")]
    return (years_filter(silver, (base, comp)).groupBy("pickup_zone").agg(*aggs)
            .where((F.col("_nb") > 0) & (F.col("_nc") > 0)))


def yoy_growing(silver: DataFrame, *, base: int = 2024, comp: int = 2025,
                min_trips: int = 1000, limit: int = 15, ascending: bool = False) -> DataFrame:
    """Zones with the largest trip growth from ``base`` to ``comp``."""
    z = _two_years(silver, base, comp, True).where(F.col("_nb") >= min_trips)
    out = z.select(
        "pickup_zone",
        F.col("_nb").alias(f"trips_{base}"),
        F.col("_nc").alias(f"trips_{comp}"),
        X.round_half_away(X.pct_change("_nc", "_nb"), 2).alias("trip_growth_pct"),
        X.round_half_away("_fb", 2).alias(f"fare_{base}"),
        X.round_half_away("_fc", 2).alias(f"fare_{comp}"),
        X.round_half_away(F.col("_fc") - F.col("_fb"), 2).alias("fare_delta"),
    )
    g = F.col("trip_growth_pct")
    return top_k(out, limit, [g.asc() if ascending else g.desc(), F.col("pickup_zone").asc()])


def yoy_declining(silver: DataFrame, *, base: int = 2024, comp: int = 2025,
                  min_trips: int = 1000, limit: int = 15) -> DataFrame:
    """A10: zones with the largest decline (counts only)."""
    z = _two_years(silver, base, comp, False).where(F.col("_nb") >= min_trips)
    out = z.select(
        "pickup_zone",
        F.col("_nb").alias(f"trips_{base}"),
        F.col("_nc").alias(f"trips_{comp}"),
        X.round_half_away(X.pct_change("_nc", "_nb"), 2).alias("trip_growth_pct"),
    )
    return top_k(out, limit, [F.col("trip_growth_pct").asc(), F.col("pickup_zone").asc()])


def monthly_trend(silver: DataFrame, *, years=ALL_YEARS) -> DataFrame:
    """Year x month trips, fare and revenue, with the month start ``ds``."""
    m = measures(silver)
    return (years_filter(silver, years).groupBy("year", "month")
            .agg(m.n().alias("total_trips"),
                 X.round_half_away(m.avg("fare_amount"), 2).alias("avg_fare"),
                 X.round_half_away(m.sum("fare_amount"), 0).alias("total_revenue"))
            .withColumn("ds", X.month_start("year", "month"))
            .orderBy("year", "month"))


def q1_comparison(silver: DataFrame, *, years=ALL_YEARS, months=(1, 3)) -> DataFrame:
    """First-quarter totals per year."""
    m = measures(silver)
    return (years_filter(silver, years).where(F.col("month").between(*months))
            .groupBy("year")
            .agg(m.n().alias("q1_trips"),
                 X.round_half_away(m.avg("fare_amount"), 2).alias("avg_fare"),
                 X.round_half_away(m.sum("fare_amount"), 0).alias("q1_revenue"),
                 F.countDistinct("pickup_zone").alias("active_zones"))
            .orderBy("year"))


def q1_growth(q1: DataFrame) -> DataFrame:
    """A13 (list): Q1 trip growth against the previous listed year."""
    w = Window.partitionBy(F.lit(0)).orderBy("year")
    return q1.select(
        "year", "q1_trips",
        F.lag("year").over(w).alias("prev_year"),
        X.growth_ratio_pct("q1_trips", F.lag("q1_trips").over(w)).alias("q1_growth_pct"),
    ).orderBy("year")


def q1_snapshot(q1: DataFrame, *, base: int = 2025, comp: int = 2026, strong: float = -5.0) -> DataFrame:
    """A13 (snapshot): Q1 of ``comp`` vs ``base`` with the reference's label."""
    s = q1.agg(
        F.sum(F.when(F.col("year") == base, F.col("q1_trips"))).alias(f"q1_{base}"),
        F.sum(F.when(F.col("year") == comp, F.col("q1_trips"))).alias(f"q1_{comp}"),
    )
    s = s.withColumn("q1_change_pct", X.growth_ratio_pct(f"q1_{comp}", f"q1_{base}"))
    return s.withColumn("label", X.change_label("q1_change_pct", strong, Q1_LABELS))
