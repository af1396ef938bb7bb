"""Difference-in-differences.

The panel (year x month x zone) is a grouped aggregate of trips.  Every DiD
statistic is a function of per-cell moments, where a cell is
(post, treated, month):

* the 2x2 means are ratios of cell sums;
* the OLS ``log1p(trips) ~ post + treated + did + C(month)`` has one design
  row per cell, so its sums follow exactly from (n, mean, centred M2) per
  cell.  HC3 is exact because leverage is constant inside a cell (idea: Wong
  et al. 2021, "You Only Compress Once", arXiv 2102.11297).

The month effects are eliminated first (Frisch-Waugh-Lovell): regressors and
outcome are centred within months, which leaves three normal equations with a
closed-form solution.  All of it is column expressions over the at most
2 x 2 x 12 cells to which Spark reduces the trips.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions import exprs as X
from ..functions.frames import one_row
from ..functions.measures import measures
from .silver import years_filter

# Reference labels for the summary and the assumed elasticity.
SUMMARY_METHOD = "difference_in_differences"
SUMMARY_TREATMENT = "manhattan_cbd_zones"
SUMMARY_EVENT = "nyc_congestion_pricing_jan2025"
ASSUMED_ELASTICITY = -0.3
EFFECT_LABELS = ("significant_reduction", "mild_reduction", "no_reduction")


def did_panel(silver: DataFrame, treated_zones: Sequence[int], *, years=(2024, 2025),
              post_year: int = 2025) -> DataFrame:
    """Zone-month panel with post/treated/did indicators and log1p(trips)."""
    is_cbd = F.when(F.col("pickup_zone").isin(list(treated_zones)), F.lit(1)).otherwise(F.lit(0))
    m = measures(silver)
    p = (years_filter(silver, years)
         .groupBy("year", "month", "pickup_zone", is_cbd.alias("is_cbd"))
         .agg(m.n().alias("trip_count"),
              m.avg("fare_amount").alias("avg_fare"),
              m.avg("fare_per_km").alias("avg_fare_per_km"),
              m.avg("trip_distance").alias("avg_distance"),
              m.avg("congestion_fee").alias("avg_congestion_fee"),
              m.sum("fare_amount").alias("total_revenue")))
    post = F.when(F.col("year") == post_year, F.lit(1)).otherwise(F.lit(0))
    return (p.withColumn("post", post)
             .withColumn("treated", F.col("is_cbd"))
             .withColumn("did", F.col("post") * F.col("treated"))
             .withColumn("log_trips", F.log1p(F.col("trip_count").cast("double"))))


def panel_counts(panel: DataFrame) -> DataFrame:
    """Panel rows and distinct zones per arm."""
    return panel.agg(
        F.count(F.lit(1)).alias("panel_rows"),
        F.countDistinct(F.when(F.col("treated") == 1, F.col("pickup_zone"))).alias("cbd_zones"),
        F.countDistinct(F.when(F.col("treated") == 0, F.col("pickup_zone"))).alias("noncbd_zones"),
    )


def _cell(t: int, p: int):
    return (F.col("treated") == t) & (F.col("post") == p)


def did_2x2(panel: DataFrame, value: str = "trip_count", extra=()) -> DataFrame:
    """The 2x2 table of panel means and the DiD estimate."""
    v = F.col(value).cast("double")
    m = panel.agg(
        X.avg_if(_cell(1, 0), v).alias("cbd_before"), X.avg_if(_cell(1, 1), v).alias("cbd_after"),
        X.avg_if(_cell(0, 0), v).alias("noncbd_before"), X.avg_if(_cell(0, 1), v).alias("noncbd_after"),
        *extra,
    )
    est = (F.col("cbd_after") - F.col("cbd_before")) - (F.col("noncbd_after") - F.col("noncbd_before"))
    return (m.withColumn("did_estimate", est)
             .withColumn("cbd_change_pct", X.growth_ratio_pct("cbd_after", "cbd_before"))
             .withColumn("noncbd_change_pct", X.growth_ratio_pct("noncbd_after", "noncbd_before"))
             .withColumn("did_pct", X.div("did_estimate", "cbd_before") * F.lit(100.0)))


def parallel_trends(panel: DataFrame, *, pre_year: int = 2024) -> DataFrame:
    """C4 (table): monthly mean trips per arm in the pre year and their growth.

    One row per month (at most 12), so the ordered window is tiny.
    """
    t = (panel.where(F.col("year") == pre_year).groupBy("month")
         .agg(X.avg_if(F.col("treated") == 0, F.col("trip_count").cast("double")).alias("non_cbd"),
              X.avg_if(F.col("treated") == 1, F.col("trip_count").cast("double")).alias("cbd")))
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    t = (t.withColumn("cbd_g", X.growth_ratio_pct("cbd", F.lag("cbd").over(w)))
          .withColumn("noncbd_g", X.growth_ratio_pct("non_cbd", F.lag("non_cbd").over(w))))
    return t.withColumn("diff", F.col("cbd_g") - F.col("noncbd_g")).orderBy("month")


def parallel_trends_check(trends: DataFrame, *, tolerance: float = 5.0) -> DataFrame:
    """C4 (verdict): mean absolute divergence of monthly growth < tolerance."""
    return (trends.agg(F.avg(F.abs("diff")).alias("avg_abs_divergence"))
            .withColumn("parallel_trends_hold", F.col("avg_abs_divergence") < F.lit(float(tolerance))))


def implied_elasticity(panel: DataFrame) -> DataFrame:
    """DiD demand change over the fee's share of the treated pre-period fare
    (one aggregation of the panel)."""
    out = did_2x2(panel, extra=[X.avg_if(_cell(1, 1), "avg_congestion_fee").alias("avg_congestion_fee"),
                                X.avg_if(_cell(1, 0), "avg_fare").alias("cbd_fare_before")]).withColumn(
        "pct_price_change", X.div("avg_congestion_fee", "cbd_fare_before") * F.lit(100.0))
    return out.select(
        "avg_congestion_fee", "cbd_fare_before", "pct_price_change", "did_pct",
        F.when(F.col("pct_price_change") != 0, F.col("did_pct") / F.col("pct_price_change"))
         .otherwise(F.lit(0.0)).alias("implied_elasticity"))


def did_cells(panel: DataFrame) -> DataFrame:
    """Per (post, treated, month) sufficient statistics of the panel.

    ``m2_y`` is the centred sum of squares of log1p(trips) inside the cell;
    Spark's variance aggregate merges partial results with the parallel
    (Chan et al.) update, so nothing cancels catastrophically.
    """
    y = F.col("log_trips")
    return (panel.groupBy("post", "treated", "month")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.avg(y).alias("mean_y"),
                 (F.var_pop(y) * F.count(F.lit(1))).alias("m2_y"),
                 F.sum(F.col("trip_count").cast("double")).alias("sum_trips"),
                 F.sum("avg_fare").alias("sum_fare"),
                 F.sum("avg_congestion_fee").alias("sum_fee")))


#: The regressors left after the month effects are eliminated.
EFFECTS = ("post", "treated", "did")
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def _sym(prefix: str, i: int, j: int) -> Column:
    """Entry of a symmetric 3x3 matrix kept as columns of its upper half."""
    return F.col(f"{prefix}{min(i, j)}{max(i, j)}")


def _inverse(prefix: str) -> dict[str, Column]:
    """Upper half of the inverse of a symmetric 3x3 matrix; null if singular."""
    m = lambda i, j: _sym(prefix, i, j)

    def cofactor(i: int, j: int) -> Column:
        r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        return ((-1) ** (i + j)) * (m(r[0], c[0]) * m(r[1], c[1]) - m(r[0], c[1]) * m(r[1], c[0]))

    det = m(0, 0) * cofactor(0, 0) + m(0, 1) * cofactor(0, 1) + m(0, 2) * cofactor(0, 2)
    scale = m(0, 0) * m(1, 1) * m(2, 2)
    usable = F.when(F.abs(det) > F.abs(scale) * F.lit(1e-12), det)
    return {f"inv{i}{j}": cofactor(i, j) / usable for i, j in _PAIRS}


def _times(prefix: str, v: Sequence[Column]) -> list[Column]:
    """Symmetric matrix times vector."""
    return [sum((_sym(prefix, i, j) * v[j] for j in range(1, 3)), _sym(prefix, i, 0) * v[0]) for i in range(3)]


def _dot(u: Sequence[Column], v: Sequence[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def did_ols_hc3(cells: DataFrame) -> DataFrame:
    """The regression table (term, coef, std_err, z, p_value, ci_lower,
    ci_upper, r_squared, n_obs) of log1p(trips) ~ post + treated + did +
    C(month), with HC3 errors, from :func:`did_cells`.

    Windows run over the cells, 48 at most.  Where post, treated and did are
    collinear within months the coefficients are null.  A panel row that
    alone decides its own fit (leverage 1) makes the errors infinite.
    """
    of_month, whole = Window.partitionBy("month"), Window.partitionBy(F.lit(0))
    n = F.col("n").cast("double")
    c = cells.select("month", n.alias("n"), F.col("mean_y").alias("y"), "m2_y",
                     *[x.cast("double").alias(f"x{i}") for i, x in enumerate((F.col("post"), F.col("treated"), F.col("post") * F.col("treated")))])
    c = c.withColumn("n_m", F.sum("n").over(of_month))
    c = c.withColumns({f"{v}_m": F.sum(F.col("n") * F.col(v)).over(of_month) / F.col("n_m") for v in ("x0", "x1", "x2", "y")})
    c = c.withColumns({f"d{i}": F.col(f"x{i}") - F.col(f"x{i}_m") for i in range(3)})
    d = [F.col(f"d{i}") for i in range(3)]

    # normal equations and their solution
    c = c.withColumns({f"a{i}{j}": F.sum(F.col("n") * d[i] * d[j]).over(whole) for i, j in _PAIRS}
                      | {f"g{i}": F.sum(F.col("n") * d[i] * (F.col("y") - F.col("y_m"))).over(whole) for i in range(3)}
                      | {"n_all": F.sum("n").over(whole), "y_all": F.sum(F.col("n") * F.col("y")).over(whole)})
    c = c.withColumns(_inverse("a"))
    c = c.withColumns({f"b{i}": v for i, v in enumerate(_times("inv", [F.col(f"g{i}") for i in range(3)]))})
    b = [F.col(f"b{i}") for i in range(3)]

    # leverage and scaled squared residuals of each cell's rows
    residual = F.col("y") - F.col("y_m") - _dot(b, d)
    c = c.withColumn("h", 1 / F.col("n_m") + _dot(d, _times("inv", d))).withColumn("sse", F.col("m2_y") + F.col("n") * residual * residual)
    c = c.withColumn("s", F.when(F.col("h") < 1 - 1e-12, F.col("sse") / ((1 - F.col("h")) * (1 - F.col("h")))).otherwise(F.when(F.col("h").isNotNull(), F.lit(float("inf")))))
    c = c.withColumns({f"m{i}{j}": F.sum(F.col("s") * d[i] * d[j]).over(whole) for i, j in _PAIRS}
                      | {"r_squared": 1 - F.sum("sse").over(whole)
                         / F.nullif(F.sum(F.col("m2_y") + F.col("n") * (F.col("y") - F.col("y_all") / F.col("n_all")) * (F.col("y") - F.col("y_all") / F.col("n_all"))).over(whole), F.lit(0.0))})
    # covariance of the three effects: inverse x meat x inverse
    column = [[F.col(f"t{i}{j}") for i in range(3)] for j in range(3)]
    c = c.withColumns({f"t{i}{j}": v for j in range(3) for i, v in enumerate(_times("m", [_sym("inv", k, j) for k in range(3)]))})
    c = c.withColumns({f"v{i}{j}": _dot([_sym("inv", i, k) for k in range(3)], column[j]) for i, j in _PAIRS})

    # one row per month: its effect and what its variance needs
    shared = [*[f"b{i}" for i in range(3)], *[f"inv{i}{j}" for i, j in _PAIRS], *[f"v{i}{j}" for i, j in _PAIRS], "r_squared", "n_all"]
    months = c.groupBy("month").agg(
        F.first("n_m").alias("n_m"), F.first("y_m").alias("y_m"), F.sum("s").alias("s"),
        *[F.first(f"x{i}_m").alias(f"x{i}") for i in range(3)], *[F.sum(F.col("s") * d[i]).alias(f"e{i}") for i in range(3)],
        *[F.first(k).alias(k) for k in shared])
    x, e = [F.col(f"x{i}") for i in range(3)], [F.col(f"e{i}") for i in range(3)]
    months = months.withColumn("effect", F.col("y_m") - _dot(b, x))
    months = months.withColumn("var", F.col("s") / (F.col("n_m") * F.col("n_m")) - 2 / F.col("n_m") * _dot(x, _times("inv", e)) + _dot(x, _times("v", x)))
    first = whole.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = {f"o_{k}": F.first(k).over(first) for k in ("month", "n_m", "effect", "var", "x0", "x1", "x2", "e0", "e1", "e2")}
    months = months.withColumns(base)
    ox, oe = [F.col(f"o_x{i}") for i in range(3)], [F.col(f"o_e{i}") for i in range(3)]
    shared_var = _dot(ox, _times("v", x)) - _dot(ox, _times("inv", e)) / F.col("n_m") - _dot(x, _times("inv", oe)) / F.col("o_n_m")
    is_base = F.col("month") == F.col("o_month")
    month_row = F.struct(
        F.when(is_base, F.lit("Intercept")).otherwise(F.concat(F.lit("C(month)[T."), F.col("month").cast("string"), F.lit("]"))).alias("term"),
        F.when(is_base, F.col("effect")).otherwise(F.col("effect") - F.col("o_effect")).alias("coef"),
        F.when(is_base, F.col("var")).otherwise(F.col("var") + F.col("o_var") - 2 * shared_var).alias("var"))
    effect_rows = [F.struct(F.lit(name).alias("term"), F.col(f"b{i}").alias("coef"), F.col(f"v{i}{i}").alias("var")) for i, name in enumerate(EFFECTS)]
    rows = F.when(is_base, F.array(month_row, *effect_rows)).otherwise(F.array(month_row))
    out = months.select(F.explode(rows).alias("e"), "r_squared", F.col("n_all").cast("long").alias("n_obs")).select("e.*", "r_squared", "n_obs")
    out = out.withColumn("std_err", F.sqrt("var")).withColumn("z", X.div("coef", "std_err"))
    half = F.lit(dist.Z_975) * F.col("std_err")
    return out.select("term", "coef", "std_err", "z", dist.normal_two_sided("z").alias("p_value"),
                      (F.col("coef") - half).alias("ci_lower"), (F.col("coef") + half).alias("ci_upper"), "r_squared", "n_obs")


def summary_columns(panel: DataFrame, n_treated_zones: int) -> DataFrame:
    """C6 without the regression: C1, C2 and C5 as one row.  A zero mean makes
    the ratio over it null."""
    demand = did_2x2(panel).select("cbd_change_pct", "noncbd_change_pct", "did_estimate", "did_pct")
    fare = did_2x2(panel, "avg_fare").select(F.col("did_estimate").alias("fare_effect"))
    price = implied_elasticity(panel).select("avg_congestion_fee", F.col("implied_elasticity").alias("elasticity"))
    r = X.round_half_even
    return one_row(demand, fare, price).select(
        F.lit(SUMMARY_METHOD).alias("method"), F.lit(SUMMARY_TREATMENT).alias("treatment"),
        F.lit(SUMMARY_EVENT).alias("policy_event"), F.lit(n_treated_zones).cast("int").alias("cbd_zones"),
        r("cbd_change_pct", 2).alias("cbd_demand_change_pct"), r("noncbd_change_pct", 2).alias("noncbd_demand_change_pct"),
        r("did_estimate", 0).alias("did_estimate_trips"), r("did_pct", 2).alias("did_effect_pct"),
        r("fare_effect", 4).alias("did_fare_effect"), r("avg_congestion_fee", 2).alias("avg_congestion_fee"),
        r("elasticity", 4).alias("implied_elasticity"), F.lit(ASSUMED_ELASTICITY).cast("double").alias("assumed_elasticity"))


def did_summary(panel: DataFrame, n_treated_zones: int) -> DataFrame:
    """The one-row summary mart."""
    ols = did_ols_hc3(did_cells(panel)).where("term = 'did'").select("coef", "p_value")
    r = X.round_half_even
    return one_row(summary_columns(panel, n_treated_zones), ols).select(
        "*", r("p_value", 4).alias("did_regression_pval"),
        r((F.exp("coef") - 1) * 100, 2).alias("did_effect_pct_reg")).drop("coef", "p_value")


def effect_label(did_pct_col, strong: float = -5.0):
    """Reduction label on the DiD percentage."""
    return X.change_label(did_pct_col, strong, EFFECT_LABELS)
