"""Aggregate measures that work on trips or on the rollup base.

A mart asks ``m = measures(df)`` and aggregates with ``m.n()``,
``m.avg("fare_amount")``, ``m.avg_if(cond, "fare_amount")`` ...  On trip
rows these are the plain aggregates; on the rollup base (one row per
year/month/hour/era/zone cell with additive sums and counts, see
``plans/rollup.py``) they re-aggregate the cell sums: an average is
sum(sums) / sum(counts), a count is sum(n), min/max combine.  So one mart
definition serves both paths, and the rollup path reads ~324k cells instead
of every trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exprs as X

# Additive columns the rollup carries for each trip measure: (sum, count).
ROLLUP_MEASURES = ("fare_amount", "fare_per_km", "trip_distance", "congestion_fee")
ROLLUP_KEYS = ("year", "month", "quarter", "pickup_hour", "time_bucket", "is_congestion_era", "pickup_zone")


def is_rollup(df: DataFrame) -> bool:
    return "n" in df.columns and "fare_amount_sum" in df.columns


class TripMeasures:
    def n(self) -> Column:
        return F.count(F.lit(1))

    def n_if(self, cond: Column) -> Column:
        return X.count_if(cond)

    def sum(self, c: str) -> Column:
        return F.sum(c)

    def avg(self, c: str) -> Column:
        return F.avg(c)

    def avg_if(self, cond: Column, c: str) -> Column:
        return X.avg_if(cond, c)

    def stddev(self, c: str) -> Column:
        return F.stddev_samp(c)

    def min(self, c: str) -> Column:
        return F.min(c)

    def max(self, c: str) -> Column:
        return F.max(c)


class RollupMeasures:
    def n(self) -> Column:
        return F.sum("n").cast("long")

    def n_if(self, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("long")

    def sum(self, c: str) -> Column:
        return F.sum(f"{c}_sum")

    def avg(self, c: str) -> Column:
        return X.div(F.sum(f"{c}_sum"), F.sum(f"{c}_n"))

    def avg_if(self, cond: Column, c: str) -> Column:
        return X.div(F.sum(F.when(cond, F.col(f"{c}_sum"))), F.sum(F.when(cond, F.col(f"{c}_n"))))

    def stddev(self, c: str) -> Column:
        """From the cells' (count, sum, M2): their M2 and what their means spread."""
        n, s = F.sum(f"{c}_n"), F.sum(f"{c}_sum")
        return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), merged_m2(c)) / F.when(n > 1, n - 1)))

    def min(self, c: str) -> Column:
        return F.min(f"{c}_min")

    def max(self, c: str) -> Column:
        return F.max(f"{c}_max")


def merged_m2(c: str) -> Column:
    """Centred sum of squares of the union of cells, as an aggregate: their
    own, plus the spread of their means around the common one."""
    n, s = F.col(f"{c}_n"), F.col(f"{c}_sum")
    return F.sum(F.col(f"{c}_m2") + X.div(s * s, n)) - X.div(F.sum(s) * F.sum(s), F.sum(n))


def measures(df: DataFrame):
    return RollupMeasures() if is_rollup(df) else TripMeasures()
