"""Mart registry and publishing (S12, S11 tally).

``MARTS`` maps each published mart name of the reference to a builder over
the two silver views.  ``publish`` writes (or loads) every mart, catching
failures per mart like the reference's upload loop, and returns a tally
DataFrame (name, rows, status).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..operators import did, experiment as E, forecast as FC, policy, seasonal, wait, yoy, zone

Builder = Callable[[DataFrame, DataFrame], DataFrame]


def _default_marts(treated_zones, *, min_trips: Mapping[str, int] | None = None) -> dict[str, Builder]:
    t = dict(min_trips or {})

    def g(k, d):
        return t.get(k, d)

    def ab_projected(y):
        return E.scenario_projection(E.stratified_design(E.zone_baseline(y, min_trips=g("baseline", 500))))

    def forecast(y):
        return FC.forecast_table(FC.monthly_series(y))

    return {
        "kpi_summary": lambda y, f: zone.kpi_summary(y),
        "zone_performance": lambda y, f: zone.zone_performance(y),
        "peak_hours": lambda y, f: zone.peak_hours(y),
        "supply_gap": lambda y, f: zone.supply_gap(y),
        "elasticity": lambda y, f: zone.elasticity(y, min_trips=g("elasticity", 30)),
        "monthly_trend": lambda y, f: yoy.monthly_trend(y),
        "yoy_summary": lambda y, f: yoy.yoy_summary(y),
        "yoy_q1_comparison": lambda y, f: yoy.q1_comparison(y),
        "yoy_top_growing_zones": lambda y, f: yoy.yoy_growing(y, min_trips=g("yoy", 1000)),
        "yoy_declining_zones": lambda y, f: yoy.yoy_declining(y, min_trips=g("yoy", 1000)),
        "seasonal_by_quarter": lambda y, f: seasonal.seasonal_by_quarter(y),
        "seasonal_zones": lambda y, f: seasonal.seasonal_zones(y, min_trips=g("seasonal_zones", 4000)),
        "seasonal_q1_vs_q3": lambda y, f: seasonal.seasonal_q1_vs_q3(y, min_trips=g("q1_q3", 2000)),
        "seasonal_time_bucket": lambda y, f: seasonal.seasonal_time_bucket(y),
        "congestion_monthly": lambda y, f: policy.congestion_monthly(y),
        "congestion_impacted_zones": lambda y, f: policy.impacted_zones(y, min_trips=g("congestion", 1200)),
        "congestion_benefited_zones": lambda y, f: policy.benefited_zones(y, min_trips=g("congestion", 1200)),
        "did_summary": lambda y, f: did.did_summary(did.did_panel(y, treated_zones), len(treated_zones)),
        "ab_test_result": lambda y, f: E.v2_result(ab_projected(y)),
        "ab_test_by_tier": lambda y, f: E.ab_test_by_tier(ab_projected(y)),
        "forecast_2026": lambda y, f: forecast(y),
        "forecast_full_series": lambda y, f: FC.bridge_series(FC.full_series(FC.monthly_series(y), forecast(y))),
        "fhv_wait_time": lambda y, f: wait.fhv_wait_time(f, min_trips=g("wait", 100)),
    }


def mart_registry(treated_zones, **kw) -> dict[str, Builder]:
    """The 23 published marts."""
    return _default_marts(treated_zones, **kw)


#: Marts built at the same time; each is a few small jobs over one scan.
AT_ONCE = 4


def publish(spark: SparkSession, silver_yellow: DataFrame, silver_fhv: DataFrame, out_dir: str,
            treated_zones, *, fmt: str = "parquet", names=None, **kw) -> DataFrame:
    """Build and write every mart; one failure does not stop the others."""
    from ..sources.sinks import write_mart

    def one(item) -> tuple[str, int | None, str]:
        name, build = item
        try:
            path = write_mart(build(silver_yellow, silver_fhv), os.path.join(out_dir, name), fmt=fmt)
            n = (spark.read.parquet(path) if fmt == "parquet" else
                 spark.read.option("header", True).csv(path)).count()
            return name, int(n), "ok"
        except Exception as e:  # noqa: BLE001
            return name, None, f"failed: {type(e).__name__}: {str(e)[:200]}"

    marts = [(k, b) for k, b in mart_registry(treated_zones, **kw).items() if not names or k in names]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), marts))
    return spark.createDataFrame(rows, "mart string, rows long, status string")
