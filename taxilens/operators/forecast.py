"""Grouped monthly forecasting.

The reference fits one additive-seasonality model to one 48-point series in
a single process.  Here the same decomposition is fitted with Spark
aggregates for any number of series at once (``group=()`` is the city,
``group=("pickup_zone",)`` fits every zone together):

* trend: ordinary least squares of y on a month index, ``regr_slope`` /
  ``regr_intercept`` per group;
* yearly seasonality: mean detrended residual per (group, month of year);
* band: +/- z * sample std of the remaining residual (z of the 95 % level);
* horizon: the next ``horizon`` month starts after each group's last month,
  generated with ``sequence`` + ``explode``;
* ``link="log"`` fits log(y) and back-transforms with ``exp``.

Every step is a window aggregate partitioned by the series keys or a row
expression over the monthly series (groups x months rows), so the model
scales with the number of series, never with the trip count.  Numbers differ
from Prophet's; the columns, horizon, band and validation are the contract.

:func:`backtest` fits that model for every origin and training length at once,
from running sums.  :func:`changepoint_forecast` lets the trend bend: it fits
each series, one row per month, in one grouped task.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.dist import Z_975
from ..functions.frames import grouped_schema
from ..functions.measures import measures
from .silver import years_filter

TRAIN_YEARS = (2022, 2023, 2024, 2025)
HORIZON = 9
# Fixed labels of the holdout accuracy check (mean absolute error % < 10 / < 20).
ACCURACY_LABELS = ((10.0, "GOOD"), (20.0, "ACCEPTABLE"))
ACCURACY_ELSE = "POOR"


def monthly_series(silver: DataFrame, *, years=TRAIN_YEARS, group: Sequence[str] = ()) -> DataFrame:
    """Per group and month start ``ds``: trips, mean fare and revenue."""
    m = measures(silver)
    ds = X.month_start("year", "month").alias("ds")   # = date_trunc('month', pickup_time)
    return (years_filter(silver, years).groupBy(*group, ds)
            .agg(m.n().alias("trip_count"),
                 m.avg("fare_amount").alias("avg_fare"),
                 m.sum("fare_amount").alias("total_revenue")))


def _month_index(ds: str = "ds"):
    return (F.year(ds) * 12 + F.month(ds) - 1).cast("double")


def _partition(group: Sequence[str]):
    # One window partition per series.  With no group keys there is a single
    # series; it holds one row per month, so the partition is bounded by the
    # calendar, not by the data.
    return Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))


def fit_models(series: DataFrame, models: dict[str, tuple[str, str]], *, group: Sequence[str] = (),
               horizon: int = HORIZON, z: float = Z_975) -> DataFrame:
    """Fit several (value, link) models on the same series in one pass.

    Plan: one shuffle by the group keys; all fits are window aggregates over
    that partitioning (``(group)`` partitioning also satisfies the
    ``(group, month-of-year)`` windows and the final per-month aggregate), so
    no join is needed.  Returns (group..., ds, <name>_yhat, <name>_lower,
    <name>_upper, <name>_trend) for the ``horizon`` months after each
    series' last month.
    """
    wg = _partition(group)
    wm = Window.partitionBy(*group, "moy")
    pts = series.select(*group, "ds", _month_index().alias("t"), F.month("ds").alias("moy"),
                        *[(F.log(F.col(v).cast("double")) if link == "log" else F.col(v).cast("double"))
                          .alias(f"_y_{n}") for n, (v, link) in models.items()])
    pts = pts.withColumn("t_last", F.max("t").over(wg)).withColumn("ds_last", F.max("ds").over(wg))
    for n in models:
        y = f"_y_{n}"
        pts = (pts.withColumn(f"_b_{n}", F.regr_slope(y, "t").over(wg))
                  .withColumn(f"_a_{n}", F.regr_intercept(y, "t").over(wg)))
        pts = pts.withColumn(f"_r_{n}", F.col(y) - (F.col(f"_a_{n}") + F.col(f"_b_{n}") * F.col("t")))
        pts = pts.withColumn(f"_s_{n}", F.avg(f"_r_{n}").over(wm))
        pts = pts.withColumn(f"_sig_{n}", F.stddev_samp(F.col(f"_r_{n}") - F.col(f"_s_{n}")).over(wg))
    keep = ["t_last", "ds_last"] + [f"_{k}_{n}" for n in models for k in ("a", "b", "s", "sig")]
    per_moy = pts.groupBy(*group, "moy").agg(*[F.first(c).alias(c) for c in keep])
    # months ahead h with month-of-year moy: h = first such h, then every 12 months
    first_h = F.pmod(F.col("moy") - F.month("ds_last") - 1, F.lit(12)) + 1
    h = per_moy.where(first_h <= horizon).withColumn(
        "h", F.explode(F.sequence(first_h, F.lit(int(horizon)), F.lit(12))))
    h = h.withColumn("ds", F.add_months("ds_last", F.col("h"))).withColumn("t", F.col("t_last") + F.col("h"))
    cols = []
    for n, (_, link) in models.items():
        back = F.exp if link == "log" else (lambda c: c)
        trend = F.col(f"_a_{n}") + F.col(f"_b_{n}") * F.col("t")
        yhat = trend + F.col(f"_s_{n}")
        band = F.lit(z) * F.col(f"_sig_{n}")
        cols += [back(yhat).alias(f"{n}_yhat"), back(yhat - band).alias(f"{n}_lower"),
                 back(yhat + band).alias(f"{n}_upper"), back(trend).alias(f"{n}_trend")]
    return h.select(*group, "ds", *cols)


def fit_forecast(series: DataFrame, value: str, *, group: Sequence[str] = (), link: str = "log",
                 horizon: int = HORIZON, z: float = Z_975) -> DataFrame:
    """Fit and forecast one ``value``: rows (group..., ds, yhat, lower, upper, trend) in the
    response scale, for the ``horizon`` months after each group's last month."""
    f = fit_models(series, {"m": (value, link)}, group=group, horizon=horizon, z=z)
    return f.select(*group, "ds", F.col("m_yhat").alias("yhat"), F.col("m_lower").alias("lower"),
                    F.col("m_upper").alias("upper"), F.col("m_trend").alias("trend"))


def forecast_trips(series: DataFrame, *, group: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """Trip forecast on the log scale, rounded to whole trips."""
    f = fit_forecast(series, "trip_count", group=group, link="log", horizon=horizon)
    return f.select(*group, "ds",
                    X.round_half_even("yhat", 0).alias("trips_forecast"),
                    X.round_half_even("lower", 0).alias("trips_lower"),
                    X.round_half_even("upper", 0).alias("trips_upper"),
                    X.round_half_even("trend", 0).alias("trend"))


def forecast_fare(series: DataFrame, *, group: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """Mean-fare forecast on the linear scale."""
    f = fit_forecast(series, "avg_fare", group=group, link="identity", horizon=horizon)
    return f.select(*group, "ds",
                    X.round_half_even("yhat", 2).alias("fare_forecast"),
                    X.round_half_even("lower", 2).alias("fare_lower"),
                    X.round_half_even("upper", 2).alias("fare_upper"))


def forecast_table(series: DataFrame, *, group: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """T3 + T5: the ``forecast_2026`` mart: trips (log scale), fare (linear) and
    revenue = trips x fare, both models fitted in the same pass."""
    f = fit_models(series, {"trips": ("trip_count", "log"), "fare": ("avg_fare", "identity")},
                   group=group, horizon=horizon)
    r = X.round_half_even
    out = f.select(*group, "ds",
                   r("trips_yhat", 0).alias("trips_forecast"), r("trips_lower", 0).alias("trips_lower"),
                   r("trips_upper", 0).alias("trips_upper"), r("trips_trend", 0).alias("trend"),
                   r("fare_yhat", 2).alias("fare_forecast"), r("fare_lower", 2).alias("fare_lower"),
                   r("fare_upper", 2).alias("fare_upper"))
    return out.withColumn("revenue_forecast",
                          r(F.col("trips_forecast") * F.col("fare_forecast"), 0)).orderBy(*group, "ds")


def validation(silver: DataFrame, forecast: DataFrame, *, holdout_years=(2026,),
               group: Sequence[str] = ()) -> DataFrame:
    """T4: holdout actuals joined to the forecast on ``ds``.

    ``error_pct`` divides by the forecast, as the reference does;
    ``error_pct_of_actual`` is the standard form.
    """
    actual = monthly_series(silver, years=holdout_years, group=group).select(
        *group, "ds", F.col("trip_count").alias("actual_trips"), F.col("avg_fare").alias("actual_fare"))
    j = actual.join(forecast.select(*group, "ds", "trips_forecast", "trips_lower", "trips_upper"),
                    list(group) + ["ds"], "inner")
    err = X.div(F.col("actual_trips") - F.col("trips_forecast"), "trips_forecast") * F.lit(100.0)
    err_a = X.div(F.col("actual_trips") - F.col("trips_forecast"), "actual_trips") * F.lit(100.0)
    return j.select(*group, "ds", "actual_trips", "actual_fare", "trips_forecast", "trips_lower",
                    "trips_upper", X.round_half_even(err, 2).alias("error_pct"),
                    err_a.alias("error_pct_of_actual")).orderBy(*group, "ds")


def accuracy(valid: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """T4: mean absolute error % and the accuracy label."""
    a = (valid.groupBy(*group) if group else valid).agg(
        F.count(F.lit(1)).alias("months"),
        F.avg(F.abs("error_pct")).alias("mape"),
        F.avg(F.abs("error_pct_of_actual")).alias("mape_of_actual"))
    (t1, l1), (t2, l2) = ACCURACY_LABELS
    return a.withColumn("accuracy", F.when(F.col("mape") < t1, F.lit(l1))
                        .when(F.col("mape") < t2, F.lit(l2)).otherwise(F.lit(ACCURACY_ELSE)))


def full_series(series: DataFrame, forecast: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """T5 (U2): actual and forecast rows stacked with a ``type`` tag."""
    act = series.select(*group, "ds", F.col("trip_count").cast("double").alias("trip_count"),
                        "avg_fare", F.lit("actual").alias("type"))
    fc = forecast.select(*group, "ds", F.col("trips_forecast").alias("trip_count"),
                         F.col("fare_forecast").alias("avg_fare"), F.lit("forecast").alias("type"))
    return act.unionByName(fc)


def bridge_series(full: DataFrame, *, bridge_year: int = 2025, bridge_month: int = 12) -> DataFrame:
    """Repeat the last actual month as a forecast row so the two lines meet.

    The month is matched with year/month predicates, not a string prefix.
    """
    last = full.where((F.col("type") == "actual") & (F.year("ds") == bridge_year)
                      & (F.month("ds") == bridge_month)).withColumn("type", F.lit("forecast"))
    return full.unionByName(last).orderBy("type", "ds")


# ------------------------------------------------------ rolling-origin backtest
#: Training lengths and months ahead of the backtest; the reference trained on
#: 24 months first and on 48 later.
BACKTEST_LENGTHS = (12, 24, 36, 48)
BACKTEST_AHEAD = (1, 2, 3)


def backtest(series: DataFrame, value: str = "trip_count", *, group: Sequence[str] = (), lengths: Sequence[int] = BACKTEST_LENGTHS,
             ahead: Sequence[int] = BACKTEST_AHEAD) -> DataFrame:
    """T4 for every origin: (group.., ds, origin, length, ahead, actual,
    forecast, error_pct), the log-linear trend plus month-of-year model of
    :func:`fit_models` trained on the ``length`` months up to ``origin``.

    Seen from the forecast month, its training months are a frame of the
    months before, and those of its month of year are the same frame among
    months of one name.  So the normal equations of every (length, ahead) are
    running sums of two windows: one shuffle by series, no join, no fit per
    origin.  A month needs all ``length`` training months, and one of its
    month of year among them.  Months are counted from a series' first, so the
    sums stay small.
    """
    y = F.log(F.col(value).cast("double"))
    pts = series.select(*group, "ds", F.col(value).cast("double").alias("actual"), y.alias("y"), F.month("ds").alias("moy"), _month_index().cast("long").alias("m"))
    pts = pts.withColumn("t", (F.col("m") - F.min("m").over(_partition(group))).cast("double"))
    by_time = _partition(group).orderBy("m")
    by_name = Window.partitionBy(*group, "moy").orderBy("m")
    t, y = F.col("t"), F.col("y")
    sums = {}
    for n in lengths:
        for h in ahead:
            for tag, w in (("a", by_time), ("s", by_name)):
                w = w.rangeBetween(-(h + n - 1), -h)
                parts = {"n": F.count(y), "t": F.sum(t), "y": F.sum(y)} | ({"tt": F.sum(t * t), "ty": F.sum(t * y)} if tag == "a" else {})
                sums |= {f"{tag}_{k}_{n}_{h}": c.over(w) for k, c in parts.items()}
    pts = pts.select(*group, "ds", "actual", "t", *[c.alias(k) for k, c in sums.items()])

    def fitted(n: int, h: int):
        s = lambda k: F.col(f"{k}_{n}_{h}")
        slope = X.div(s("a_n") * s("a_ty") - s("a_t") * s("a_y"), s("a_n") * s("a_tt") - s("a_t") * s("a_t"))
        # trend at t plus the mean residual of the month of year; the intercept cancels
        yhat = slope * (F.col("t") - X.div(s("s_t"), s("s_n"))) + X.div(s("s_y"), s("s_n"))
        ok = (s("a_n") == n) & (s("s_n") > 0)
        return F.struct(F.lit(n).alias("length"), F.lit(h).alias("ahead"), F.when(ok, F.exp(yhat)).alias("forecast"))

    rows = pts.select(*group, "ds", "actual", F.explode(F.array(*[fitted(n, h) for n in lengths for h in ahead])).alias("f"))
    rows = rows.select(*group, "ds", "actual", "f.*").where(F.col("forecast").isNotNull())
    return rows.select(*group, "ds", F.add_months("ds", -F.col("ahead")).alias("origin"), "length", "ahead", "actual", "forecast",
                       (X.div(F.col("actual") - F.col("forecast"), "forecast") * F.lit(100.0)).alias("error_pct"))


def backtest_accuracy(tested: DataFrame, *, by: Sequence[str] = ("length", "ahead")) -> DataFrame:
    """Mean absolute error % of a backtest per training length and months ahead."""
    return tested.groupBy(*by).agg(F.count(F.lit(1)).alias("months"), F.avg(F.abs("error_pct")).alias("mape")).orderBy(*by)


# ---------------------------------------------------- trend with changepoints
#: Candidate breaks lie evenly in this first share of a series' months.
BREAKS, BREAK_SHARE = 24, 0.85
FOURIER = 4
PENALTIES = 16
#: The path of penalties ends with the first set of more breaks than this.
MOST_BREAKS = 6


def _design(t: np.ndarray, moy: np.ndarray, span: float) -> np.ndarray:
    """Intercept, slope and yearly Fourier terms."""
    turn = 2 * np.pi * np.outer(moy, np.arange(1, FOURIER + 1)) / 12
    return np.column_stack([np.ones(len(t)), t / span, np.sin(turn), np.cos(turn)])


def coordinate_descent(gram: np.ndarray, corr: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 500, tol: float = 1e-9) -> np.ndarray:
    """Minimum of 1/2 d'Gd - c'd + penalty * |d|_1, one coordinate at a time.
    A round visits what is not zero or should not be."""
    d, own = start.copy(), gram.diagonal()
    grad = corr - gram @ d
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero((own > 0) & ((d != 0) | (np.abs(grad) > penalty))):
            z = grad[j] + own[j] * d[j]
            new = np.sign(z) * max(abs(z) - penalty, 0.0) / own[j]
            change = new - d[j]
            if change:
                d[j] = new
                grad -= gram[j] * change
                most = max(most, abs(change))
        if most < tol:
            break
    return d


def fit_changepoints(t: np.ndarray, moy: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(breaks, slope changes, other coefficients, residual deviation).

    What is not penalised is eliminated from y and the hinges first; the
    changes of slope then follow by coordinate descent on the hinges' Gram
    matrix, for falling penalties, each from the last.  Of the sets of breaks
    on that path, each refitted by least squares, the one of smallest BIC is kept.
    """
    span = max(float(t[-1] - t[0]), 1.0)
    breaks = np.unique(np.round(t[0] + (t[-1] - t[0]) * BREAK_SHARE * np.arange(1, BREAKS + 1) / BREAKS))
    base = _design(t, moy, span)
    hinge = np.maximum(t[:, None] - breaks[None, :], 0.0) / span
    off = lambda v: v - base @ np.linalg.lstsq(base, v, rcond=None)[0]
    h, r = off(hinge), off(y)
    n = len(y)
    gram, corr = h.T @ h / n, h.T @ r / n
    floor = 1e-12 * max(float(y @ y), 1e-300)  # a perfect fit has no better one
    best, d = None, np.zeros(len(breaks))
    sets = [np.zeros(0, int)]
    for penalty in np.abs(corr).max(initial=0.0) * np.logspace(0, -3, PENALTIES):
        d = coordinate_descent(gram, corr, penalty, d, rounds=200, tol=1e-5)
        sets.append(np.flatnonzero(d))
        if len(sets[-1]) > MOST_BREAKS:
            break
    for active in {tuple(s) for s in sets}:
        x = np.column_stack([base, hinge[:, list(active)]])
        if x.shape[1] >= n:
            continue
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        sse = max(float(((y - x @ beta) ** 2).sum()), floor)
        bic = n * np.log(sse / n) + (x.shape[1] + len(active)) * np.log(n)  # a break costs its place and its change
        if best is None or bic < best[0]:
            best = bic, active, beta, np.sqrt(sse / max(n - x.shape[1], 1))
    if best is None:  # fewer months than terms: the trend alone
        x = base[:, :2]
        beta = np.concatenate([np.linalg.lstsq(x, y, rcond=None)[0], np.zeros(base.shape[1] - 2)])
        return np.zeros(0), np.zeros(0), beta, float(np.sqrt(((y - base @ beta) ** 2).mean()))
    _, active, beta, sigma = best
    return breaks[list(active)], beta[base.shape[1]:], beta[:base.shape[1]], float(sigma)


def changepoint_forecast(series: DataFrame, value: str = "trip_count", *, group: Sequence[str] = (), link: str = "log",
                         horizon: int = HORIZON, z: float = Z_975) -> DataFrame:
    """T1, T2 with a trend that may bend: (group.., ds, yhat, lower, upper,
    trend, n_breaks, last_break) for ``horizon`` months after each series' last.

    One shuffle by series.  A group holds one row per month, so its size is
    bounded by the calendar.  Null and (on the log scale) non-positive values
    are left out.
    """
    y = F.col(value).cast("double")
    pts = series.select(*group, "ds", _month_index().cast("long").alias("t"), (F.log(F.when(y > 0, y)) if link == "log" else y).alias("y")).dropna(subset=["y", "t"])
    out = "ds date, yhat double, lower double, upper double, trend double, n_breaks int, last_break date"

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("t").to_numpy())
        t, y = table.column("t").to_numpy()[order].astype(float), table.column("y").to_numpy()[order]
        breaks, change, beta, sigma = fit_changepoints(t, (t % 12) + 1, y)
        ahead = t[-1] + np.arange(1, horizon + 1)
        span = max(float(t[-1] - t[0]), 1.0)
        base = _design(ahead, (ahead % 12) + 1, span)
        trend = base[:, :2] @ beta[:2] + (np.maximum(ahead[:, None] - breaks[None, :], 0.0) / span) @ change
        yhat = trend + base[:, 2:] @ beta[2:]
        back = np.exp if link == "log" else (lambda v: v)
        day = lambda m: datetime.date(int(m) // 12, int(m) % 12 + 1, 1)
        cols = {g: pa.array([k.as_py()] * horizon, k.type) for g, k in zip(group, key, strict=False)}
        cols |= {"ds": pa.array([day(m) for m in ahead], pa.date32()), "yhat": pa.array(back(yhat)), "lower": pa.array(back(yhat - z * sigma)),
                 "upper": pa.array(back(yhat + z * sigma)), "trend": pa.array(back(trend)), "n_breaks": pa.array([len(breaks)] * horizon, pa.int32()),
                 "last_break": pa.array([day(breaks[-1]) if len(breaks) else None] * horizon, pa.date32())}
        return pa.table(cols)

    keyed = pts if group else pts.withColumn("__one", F.lit(0))
    return keyed.groupBy(*(group or ("__one",))).applyInArrow(fit, grouped_schema(series, group, out))
