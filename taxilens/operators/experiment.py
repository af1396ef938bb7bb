"""Pricing experiments.

Design choices for scale and reproducibility:

* Random assignment uses a seeded hash of the unit key, never ``rand()``:
  a recomputed partition (lost executor, AQE re-plan) gets the same arms.
  The hash is md5 over integers (``exprs.hash_key``), which SQL oracles repeat.
* Zone-level designs work on the zone baseline, whose size is bounded by the
  zone dimension.  Trip-level designs never collect trips: every test
  statistic is computed from per-arm moments (count, mean, var_samp) that
  Spark aggregates with partial/final merges.
* Only the final p-values and t quantiles need a distribution function; they
  are evaluated by Arrow-batched pandas UDFs on one row per test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions import exprs as X
from ..functions.frames import attach_global, one_row
from ..functions.measures import measures
from .silver import years_filter

# ---------------------------------------------------------------------------
# Fixed values of the reference's experiment design.
SURGE_MULTIPLIER = 1.10
ALPHA = 0.05
RANDOM_SEED = 42
ELASTICITY = -0.3
MEAN_EFFECT = 1 + ELASTICITY * (SURGE_MULTIPLIER - 1)   # 0.97
EFFECT_CLIP = (0.85, 1.10)
HIGH_FARE = 25.0
TIERS = ("large", "medium", "small")
CONTROL, TREATMENT = "control", "treatment"
# Output names of the v3/v4 result marts (the reference's column contract;
# the isolated unit is a parameter, the names are fixed).
V3_EXPERIMENT, V3_DESIGN = "fee_increase_10pct_v3_non_jfk", "stratified_jfk_isolated"
V3_REST_UPLIFT, V3_ISOLATED_UPLIFT = "revenue_uplift_nojfk", "jfk_uplift"
V4_P_REST, V4_SIG_REST = "p_value_perm_nojfk", "significant_nojfk"
# Load-time label of the per-tier result (replaces the boolean column).
PASS_LABEL, FAIL_LABEL = "✅ pass", "✗ fail"
# ---------------------------------------------------------------------------

EXPERIMENT_YEARS = (2024, 2025, 2026)


def zone_baseline(silver: DataFrame, *, years=EXPERIMENT_YEARS, min_trips: int = 500) -> DataFrame:
    """Per-zone volume, fare and estimated revenue (count x avg fare)."""
    m = measures(silver)
    return (years_filter(silver, years).groupBy("pickup_zone")
            .agg(m.n().alias("total_trips"), m.avg("fare_amount").alias("avg_fare"))
            .where(F.col("total_trips") >= min_trips)
            .withColumn("est_revenue", F.col("total_trips") * F.col("avg_fare")))


def baseline_dispersion(baseline: DataFrame, volume: str = "total_trips") -> DataFrame:
    """Volume range and coefficient of variation (sample std / mean)."""
    v = F.col(volume)
    return baseline.agg(
        F.count(F.lit(1)).alias("eligible_zones"),
        F.min(v).alias("min_trips"), F.max(v).alias("max_trips"),
        X.div(F.stddev_samp(v), F.avg(v)).alias("cv"))


def with_tier(baseline: DataFrame, *, volume: str = "total_trips", low: float = 0.25,
              high: float = 0.75, name: str = "tier") -> DataFrame:
    """Large if >= q(high), medium if >= q(low), else small.

    Quantiles interpolate linearly (``percentile``), like pandas.
    """
    t = attach_global(baseline,
                      _qh=F.percentile(F.col(volume), high),
                      _ql=F.percentile(F.col(volume), low))
    v = F.col(volume)
    tier = (F.when(v >= F.col("_qh"), F.lit(TIERS[0]))
             .when(v >= F.col("_ql"), F.lit(TIERS[1]))
             .otherwise(F.lit(TIERS[2])))
    return t.withColumn(name, tier).drop("_qh", "_ql")


def order_key(unit: str | Column, seed: int) -> Column:
    """Seeded pseudo-random order of units; reproducible under recomputation."""
    return X.hash_key(int(seed), unit)


def assign_stratified(units: DataFrame, *, stratum: str = "tier", unit: str = "pickup_zone",
                      seed: int = RANDOM_SEED, name: str = "group") -> DataFrame:
    """Shuffle units inside each stratum; the first floor(n/2) are control.

    The window partitions by stratum over the zone baseline (bounded by the
    zone dimension).  Trip-scale units use :func:`assign_trips` instead.
    """
    w = Window.partitionBy(stratum).orderBy(order_key(unit, seed), F.col(unit))
    n = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    return (units.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n)
            .withColumn(name, F.when(F.col("_rn") <= F.floor(F.col("_n") / 2), F.lit(CONTROL))
                        .otherwise(F.lit(TREATMENT)))
            .drop("_rn", "_n"))


def unstratified_design(baseline: DataFrame, *, seed: int = RANDOM_SEED) -> DataFrame:
    """X3 (v1): one stratum, half of all zones to control."""
    return assign_stratified(baseline.withColumn("tier", F.lit("all")), seed=seed)


def stratified_design(baseline: DataFrame, *, seed: int = RANDOM_SEED) -> DataFrame:
    """v2: tier all eligible zones, assign within tiers."""
    return assign_stratified(with_tier(baseline), seed=seed)


def isolated_design(baseline: DataFrame, isolated_zone: int, *, seed: int = RANDOM_SEED) -> DataFrame:
    """X4 (v3): drop the dominant unit, re-tier as ``tier_v3``, re-assign with seed + 1."""
    rest = baseline.where(F.col("pickup_zone") != isolated_zone)
    return assign_stratified(with_tier(rest, name="tier_v3"), stratum="tier_v3",
                             seed=seed + 1, name="group_v3")


def tier_summary(assigned: DataFrame, *, tier: str = "tier", group: str = "group") -> DataFrame:
    """Zones, total trips and mean zone fare per tier and arm."""
    return (assigned.groupBy(tier, group)
            .agg(F.count(F.lit(1)).alias("zones"),
                 F.sum("total_trips").alias("total_trips"),
                 X.round_half_even(F.avg("avg_fare"), 2).alias("avg_fare"))
            .orderBy(tier, group))


def scenario_projection(assigned: DataFrame, *, effect: float | DataFrame = MEAN_EFFECT,
                        multiplier: float = SURGE_MULTIPLIER, group: str = "group",
                        clip: tuple[float, float] = EFFECT_CLIP) -> DataFrame:
    """Apply a demand effect and the fee multiplier to treatment zones.

    ``effect`` is a constant or a DataFrame (pickup_zone, effect) joined on
    the zone (the per-zone effect table replacing the reference's random
    draw).  Control rows keep their observed values.
    """
    df = assigned
    if isinstance(effect, DataFrame):
        df = df.join(effect.select("pickup_zone", F.col("effect").alias("_eff")), "pickup_zone", "left")
        eff = F.coalesce(F.col("_eff"), F.lit(float(MEAN_EFFECT)))
    else:
        eff = F.lit(float(effect))
    treated = F.col(group) == TREATMENT
    e = X.clamp(eff, *clip)
    out = (df.withColumn("zone_demand_effect", F.when(treated, e))
             .withColumn("sim_trips", F.when(treated, F.col("total_trips") * e)
                         .otherwise(F.col("total_trips").cast("double")))
             .withColumn("sim_fare", F.when(treated, F.col("avg_fare") * F.lit(float(multiplier)))
                         .otherwise(F.col("avg_fare")))
             .withColumn("sim_revenue", F.when(treated, F.col("sim_trips") * F.col("sim_fare"))
                         .otherwise(F.col("est_revenue"))))
    return out.drop("_eff") if "_eff" in out.columns else out


def zone_detail(projected: DataFrame, *, tier: str = "tier", group: str = "group") -> DataFrame:
    """The ``ab_test_zones`` mart: control as observed, treatment as simulated."""
    return projected.select(
        "pickup_zone", F.col(tier).alias("tier"),
        F.col("sim_trips").alias("total_trips"),
        F.col("sim_fare").alias("avg_fare"),
        F.col("sim_revenue").alias("est_revenue"),
        F.col(group).alias("group"))


# ------------------------------------------------------------------ tests
def arm_moments(df: DataFrame, value: str | Column, arm: str = "group", by: Sequence[str] = (),
                extra: Sequence[Column] = ()) -> DataFrame:
    """Per-arm n, mean, sample variance and population variance of ``value``
    (plus any ``extra`` aggregates, computed in the same pass)."""
    v = X.col(value).cast("double")
    aggs = []
    for tag, label in (("c", CONTROL), ("t", TREATMENT)):
        sel = F.col(arm) == label
        x = F.when(sel, v)
        aggs += [X.count_if(sel & v.isNotNull()).alias(f"n_{tag}"), F.avg(x).alias(f"mean_{tag}"),
                 F.var_samp(x).alias(f"var_{tag}"), F.var_pop(x).alias(f"varp_{tag}"),
                 F.sum(x).alias(f"sum_{tag}")]
    return (df.groupBy(*by) if by else df).agg(*aggs, *extra)


def welch_columns(m: DataFrame, *, ddof_d: int = 0, d_direction: str = "control_minus_treatment") -> DataFrame:
    """Welch t (control minus treatment, as scipy's argument order), df, Cohen's d."""
    vc_n, vt_n = X.div("var_c", "n_c"), X.div("var_t", "n_t")
    se2 = vc_n + vt_n
    t = X.div(F.col("mean_c") - F.col("mean_t"), F.sqrt(se2))
    dfw = X.div(se2 * se2, X.div(F.pow(vc_n, 2), F.col("n_c") - 1) + X.div(F.pow(vt_n, 2), F.col("n_t") - 1))
    vc, vt = (F.col("varp_c"), F.col("varp_t")) if ddof_d == 0 else (F.col("var_c"), F.col("var_t"))
    pooled = F.sqrt((vc + vt) / F.lit(2.0))
    diff = (F.col("mean_c") - F.col("mean_t")) if d_direction == "control_minus_treatment" \
        else (F.col("mean_t") - F.col("mean_c"))
    d = F.when(pooled > 0, diff / pooled).otherwise(F.lit(0.0))
    return (m.withColumn("t_stat", t).withColumn("df", dfw).withColumn("cohens_d", d)
             .withColumn("sem_t", F.sqrt(X.div("var_t", "n_t"))))


def with_inference(w: DataFrame, *, alpha: float = ALPHA) -> DataFrame:
    """Add the p-value and the t interval around the treatment mean (df = n_t - 1)."""
    q = dist.t_ppf(F.lit(1.0 - alpha / 2.0), (F.col("n_t") - 1).cast("double"))
    return (w.withColumn("p_value", dist.t_two_sided_p(F.col("t_stat"), F.col("df")))
             .withColumn("significant", F.col("p_value") < F.lit(float(alpha)))
             .withColumn("_q", q)
             .withColumn("ci_lower", F.col("mean_t") - F.col("_q") * F.col("sem_t"))
             .withColumn("ci_upper", F.col("mean_t") + F.col("_q") * F.col("sem_t"))
             .drop("_q"))


def welch_overall(projected: DataFrame, *, group: str = "group") -> DataFrame:
    """X7 on zones: control trips vs simulated treatment trips."""
    return welch_columns(arm_moments(projected, "sim_trips", arm=group))


def welch_by_tier(projected: DataFrame, *, tier: str = "tier", group: str = "group") -> DataFrame:
    """Welch per tier; tiers with fewer than 2 zones in an arm are skipped."""
    w = welch_columns(arm_moments(projected, "sim_trips", arm=group, by=[tier]))
    w = w.where((F.col("n_c") >= 2) & (F.col("n_t") >= 2))
    return w.select(
        F.col(tier).alias("tier"),
        F.col("n_c").alias("ctrl_zones"), F.col("n_t").alias("treat_zones"),
        X.round_half_even("mean_c", 0).alias("ctrl_mean_trips"),
        X.round_half_even("mean_t", 0).alias("treat_mean_trips"),
        X.round_half_even("t_stat", 4).alias("t_stat"),
        "df",
        X.round_half_even("cohens_d", 4).alias("cohens_d"),
    ).orderBy("tier")


def ab_test_by_tier(projected: DataFrame, *, alpha: float = ALPHA, **kw) -> DataFrame:
    """X8 mart with p-value and the pass/fail label the load step derives."""
    w = welch_columns(arm_moments(projected, "sim_trips", arm=kw.get("group", "group"),
                                  by=[kw.get("tier", "tier")]))
    w = w.where((F.col("n_c") >= 2) & (F.col("n_t") >= 2))
    p = dist.t_two_sided_p(F.col("t_stat"), F.col("df"))
    return w.select(
        F.col(kw.get("tier", "tier")).alias("tier"),
        F.col("n_c").alias("ctrl_zones"), F.col("n_t").alias("treat_zones"),
        X.round_half_even("mean_c", 0).alias("ctrl_mean_trips"),
        X.round_half_even("mean_t", 0).alias("treat_mean_trips"),
        X.round_half_even("t_stat", 4).alias("t_stat"),
        X.round_half_even(p, 4).alias("p_value"),
        X.round_half_even("cohens_d", 4).alias("cohens_d"),
        F.when(p < F.lit(alpha), F.lit(PASS_LABEL)).otherwise(F.lit(FAIL_LABEL)).alias("result"),
    ).orderBy("tier")


def balance(assigned: DataFrame, *, group: str = "group", volume: str = "total_trips") -> DataFrame:
    """X9 (zones): trips per arm and the imbalance in percent of control."""
    b = assigned.agg(
        F.sum(F.when(F.col(group) == CONTROL, F.col(volume))).alias("control_trips"),
        F.sum(F.when(F.col(group) == TREATMENT, F.col(volume))).alias("treatment_trips"))
    return b.withColumn("imbalance_pct",
                        X.div(F.abs(F.col("control_trips") - F.col("treatment_trips")).cast("double"),
                              F.col("control_trips")) * F.lit(100.0))


def revenue_impact(projected: DataFrame, *, tier: str = "tier", group: str = "group") -> DataFrame:
    """Treatment revenue before/after, overall ('all') and per tier, one rollup."""
    t = projected.where(F.col(group) == TREATMENT)
    r = (t.rollup(tier)
         .agg(F.sum(F.col("total_trips").cast("double")).alias("trips_before"),
              F.sum("sim_trips").alias("trips_after"),
              F.sum("est_revenue").alias("revenue_before"),
              F.sum("sim_revenue").alias("revenue_after"),
              F.avg("zone_demand_effect").alias("mean_demand_effect")))
    return (r.select(F.coalesce(F.col(tier), F.lit("all")).alias("tier"), "trips_before", "trips_after",
                     (F.col("trips_before") - F.col("trips_after")).alias("trip_loss"),
                     "revenue_before", "revenue_after",
                     (F.col("revenue_after") - F.col("revenue_before")).alias("revenue_uplift"),
                     (X.div(F.col("revenue_after") - F.col("revenue_before"), F.col("revenue_before"))
                      * F.lit(100.0)).alias("revenue_uplift_pct"),
                     "mean_demand_effect")
            .orderBy("tier"))


def isolated_unit(baseline: DataFrame, zone_id: int, *, effect: float = MEAN_EFFECT,
                  multiplier: float = SURGE_MULTIPLIER) -> DataFrame:
    """The isolated zone on its own: simulated trips, revenue and uplift."""
    z = baseline.where(F.col("pickup_zone") == zone_id)
    sim_trips = F.col("total_trips") * F.lit(float(effect))
    sim_rev = sim_trips * F.col("avg_fare") * F.lit(float(multiplier))
    return z.select("pickup_zone", "total_trips", "avg_fare", "est_revenue",
                    sim_trips.alias("sim_trips"), sim_rev.alias("sim_revenue"),
                    (sim_rev - F.col("est_revenue")).alias("uplift"))


def decision(p: Column, uplift: Column, alpha: float = ALPHA) -> Column:
    """ROLL OUT / INCONCLUSIVE / DO NOT ROLL OUT."""
    return (F.when((p < F.lit(alpha)) & (uplift > 0), F.lit("ROLL OUT"))
             .when(p >= F.lit(alpha), F.lit("INCONCLUSIVE"))
             .otherwise(F.lit("DO NOT ROLL OUT")))


def v2_result(projected: DataFrame, *, alpha: float = ALPHA) -> DataFrame:
    """The 17-column ``ab_test_result`` mart of the stratified design."""
    w = with_inference(welch_overall(projected), alpha=alpha)
    imp = revenue_impact(projected).where(F.col("tier") == "all")
    r = lambda c, d: X.round_half_even(c, d)  # noqa: E731  pandas-side rounding
    out = one_row(w, imp).select(
        F.lit("fee_increase_10pct_stratified").alias("experiment"),
        F.lit("stratified_by_volume_tier").alias("design"),
        F.col("n_c").alias("control_zones"), F.col("n_t").alias("treatment_zones"),
        F.lit(SURGE_MULTIPLIER).alias("surge_multiplier"),
        F.lit(ELASTICITY).alias("elasticity_assumed"),
        r((F.col("mean_demand_effect") - 1) * 100, 2).alias("mean_demand_effect_pct"),
        r("trip_loss", 0).alias("trip_loss"),
        r("revenue_uplift", 2).alias("revenue_uplift_usd"),
        r("revenue_uplift_pct", 2).alias("revenue_uplift_pct"),
        r("t_stat", 4).alias("t_statistic"),
        r("p_value", 4).alias("p_value"),
        r("cohens_d", 4).alias("cohens_d"),
        "significant",
        r("ci_lower", 0).alias("ci_lower_trips"),
        r("ci_upper", 0).alias("ci_upper_trips"),
        decision(F.col("p_value"), F.col("revenue_uplift"), alpha).alias("recommendation"),
    )
    return out


def v3_result(baseline: DataFrame, isolated_zone: int, *, seed: int = RANDOM_SEED, alpha: float = ALPHA) -> DataFrame:
    """The 12-column v3 result (isolated unit + re-stratified rest)."""
    design = isolated_design(baseline, isolated_zone, seed=seed)
    proj = scenario_projection(design, group="group_v3")
    w = with_inference(welch_overall(proj, group="group_v3"), alpha=alpha)
    imp = revenue_impact(proj, tier="tier_v3", group="group_v3").where(F.col("tier") == "all") \
        .select(F.col("revenue_uplift").alias("uplift_rest"))
    iso = isolated_unit(baseline, isolated_zone).agg(F.sum("uplift").alias("uplift_iso"))
    r = lambda c, d: X.round_half_even(c, d)
    iso_u = F.coalesce(F.col("uplift_iso"), F.lit(0.0))
    return one_row(w, imp, iso).select(
        F.lit(V3_EXPERIMENT).alias("experiment"),
        F.lit(V3_DESIGN).alias("design"),
        F.col("n_c").alias("control_zones"), F.col("n_t").alias("treatment_zones"),
        r("t_stat", 4).alias("t_statistic"), r("p_value", 4).alias("p_value"),
        r("cohens_d", 4).alias("cohens_d"), "significant",
        r("uplift_rest", 0).alias(V3_REST_UPLIFT),
        r(iso_u, 0).alias(V3_ISOLATED_UPLIFT),
        r(iso_u + F.col("uplift_rest"), 0).alias("total_uplift"),
        decision(F.col("p_value"), F.col("uplift_rest"), alpha).alias("recommendation"),
    )


# ------------------------------------------------------- trip-level design
def trip_key(ts: str = "pickup_time") -> Column:
    """Whole seconds since the epoch of a zone-less timestamp."""
    return F.timestamp_diff("SECOND", X.ts_ntz("1970-01-01 00:00:00"), F.col(ts))


def trip_identity() -> list[Column]:
    """What tells a trip from another, as integers."""
    return [trip_key(), F.col("pickup_zone"), F.col("dropoff_zone"),
            X.hundredths("fare_amount"), X.hundredths("trip_distance")]


def assign_trips(silver: DataFrame, *, seed: int = RANDOM_SEED,
                 years=EXPERIMENT_YEARS, multiplier: float = SURGE_MULTIPLIER) -> DataFrame:
    """Independent 50/50 assignment per trip by a seeded hash.

    A per-row expression: no shuffle, stable under repartitioning and task
    retries.  Treatment trips get the fee multiplier as ``sim_fare``.
    """
    bit = X.hash_key(int(seed), *trip_identity()) % F.lit(2)
    g = F.when(bit == 0, F.lit(CONTROL)).otherwise(F.lit(TREATMENT))
    t = years_filter(silver, years).withColumn("group", g)
    return t.withColumn("sim_fare", F.when(F.col("group") == TREATMENT,
                                           F.col("fare_amount") * F.lit(float(multiplier)))
                        .otherwise(F.col("fare_amount")))


def trip_summary(trips: DataFrame, *, threshold: float = HIGH_FARE) -> DataFrame:
    """All per-arm statistics of the trip-level design in ONE aggregation
    (one scan of the trips): simulated-fare moments, observed-fare means
    and high-fare counts."""
    c, t = F.col("group") == CONTROL, F.col("group") == TREATMENT
    hi = (F.col("sim_fare") > F.lit(float(threshold))).cast("double")
    m = arm_moments(trips, "sim_fare", extra=[
        X.avg_if(c, "fare_amount").alias("ctrl_avg_fare"), X.avg_if(t, "fare_amount").alias("treat_avg_fare"),
        X.sum_if(c, hi).alias("k_c"), X.sum_if(t, hi).alias("k_t")])
    return welch_columns(m, ddof_d=1, d_direction="treatment_minus_control")


def trip_welch(trips: DataFrame) -> DataFrame:
    """X14 + X9 + X16: fare test on simulated fares, balance and revenue uplift."""
    return _trip_welch_cols(trip_summary(trips))


def _trip_welch_cols(w: DataFrame) -> DataFrame:
    return w.select(
        F.col("n_c").alias("control_trips"), F.col("n_t").alias("treatment_trips"),
        "ctrl_avg_fare", "treat_avg_fare",
        (F.col("treat_avg_fare") - F.col("ctrl_avg_fare")).alias("balance_diff"),
        F.col("mean_c").alias("ctrl_sim_fare"), F.col("mean_t").alias("treat_sim_fare"),
        (F.col("mean_t") - F.col("mean_c")).alias("fare_difference"),
        "t_stat", "df", "cohens_d", "sem_t",
        (X.div(F.col("sum_t") - F.col("sum_c"), F.col("sum_c")) * F.lit(100.0)).alias("revenue_uplift_pct"),
    )


def prop_ztest(trips: DataFrame, *, threshold: float = HIGH_FARE) -> DataFrame:
    """Two-proportion z test of sim_fare > threshold between arms."""
    return _with_prop(trip_summary(trips, threshold=threshold)).select(
        "n_c", "n_t", "ctrl_rate", "treat_rate", "rate_diff", "z_stat")


def _with_prop(s: DataFrame) -> DataFrame:
    """Add the proportion-test columns to a ``trip_summary`` row."""
    s = (s.withColumn("ctrl_rate", X.div("k_c", "n_c"))
          .withColumn("treat_rate", X.div("k_t", "n_t"))
          .withColumn("p_pool", X.div(F.col("k_c") + F.col("k_t"), F.col("n_c") + F.col("n_t"))))
    se = F.sqrt(F.col("p_pool") * (1 - F.col("p_pool")) * (X.div(F.lit(1.0), "n_c") + X.div(F.lit(1.0), "n_t")))
    return (s.withColumn("rate_diff", F.col("treat_rate") - F.col("ctrl_rate"))
             .withColumn("z_stat", F.when(se > 0, (F.col("treat_rate") - F.col("ctrl_rate")) / se)
                         .otherwise(F.lit(0.0))))


def welch_by_bucket(trips: DataFrame, *, min_n: int = 30) -> DataFrame:
    """Simulated-fare Welch test per time bucket, n >= min_n in both arms."""
    w = welch_columns(arm_moments(trips, "sim_fare", by=["time_bucket"]), ddof_d=1,
                      d_direction="treatment_minus_control")
    return (w.where((F.col("n_c") >= min_n) & (F.col("n_t") >= min_n))
            .select("time_bucket", "n_c", "n_t",
                    (F.col("mean_t") - F.col("mean_c")).alias("fare_diff"), "t_stat", "df")
            .orderBy("time_bucket"))


def two_year_fare_test(silver: DataFrame, *, pre: int = 2024, post: int = 2025,
                       sample_per_year: int | None = None, seed: int = RANDOM_SEED) -> DataFrame:
    """Welch test of fares, ``pre`` year vs ``post`` year.

    All trips by default; ``sample_per_year`` draws the reference's
    exact-size uniform sample per year first (L3).
    """
    arms = years_filter(silver, (pre, post))
    if sample_per_year:
        from .sampling import sample_exact
        arms = sample_exact(arms, sample_per_year, keys=trip_identity(), seed=seed, by="year")
    arms = arms.withColumn("group", F.when(F.col("year") == pre, F.lit(CONTROL)).otherwise(F.lit(TREATMENT)))
    w = welch_columns(arm_moments(arms, "fare_amount"))
    return w.select(F.col("n_c").alias("n_pre"), F.col("n_t").alias("n_post"),
                    F.col("mean_c").alias("mean_pre"), F.col("mean_t").alias("mean_post"),
                    (F.col("mean_t") - F.col("mean_c")).alias("fare_change"), "t_stat", "df")


def v5_result(trips: DataFrame, *, alpha: float = ALPHA, multiplier: float = SURGE_MULTIPLIER) -> DataFrame:
    """The 14-column trip-level result (full population, one trip scan)."""
    s = _with_prop(trip_summary(trips))
    s = (s.withColumn("p_value", dist.t_two_sided_p(F.col("t_stat"), F.col("df")))
          .withColumn("prop_test_p", dist.normal_two_sided_p(F.col("z_stat"))))
    r = lambda c, d: X.round_half_even(c, d)
    return s.select(
        F.lit("fee_increase_10pct_v5_trip_level").alias("experiment"),
        F.lit("trip").alias("unit"),
        (F.col("n_c") + F.col("n_t")).alias("sample_size"),
        F.col("n_c").alias("control_trips"), F.col("n_t").alias("treatment_trips"),
        F.lit(float(multiplier)).alias("surge_multiplier"),
        r("t_stat", 4).alias("t_statistic"), r("p_value", 6).alias("p_value"),
        r("cohens_d", 4).alias("cohens_d"), (F.col("p_value") < alpha).alias("significant"),
        r(X.div(F.col("sum_t") - F.col("sum_c"), F.col("sum_c")) * F.lit(100.0), 2).alias("revenue_uplift_pct"),
        r("ctrl_rate", 4).alias("high_fare_rate_ctrl"), r("treat_rate", 4).alias("high_fare_rate_treat"),
        r("prop_test_p", 6).alias("prop_test_p"),
    )


def v1_result(baseline: DataFrame, *, seed: int = RANDOM_SEED) -> DataFrame:
    """X21, first row: the random split without strata, computed like the others."""
    proj = scenario_projection(unstratified_design(baseline, seed=seed))
    return with_inference(welch_overall(proj)).select(X.round_half_even("p_value", 4).alias("p_value"), "cohens_d")


def design_comparison(v1: DataFrame, v2: DataFrame, v3: DataFrame, v4: DataFrame, v5: DataFrame,
                      *, alpha: float = ALPHA) -> DataFrame:
    """One row per design: version, unit, test, p-value, significant.
    Each result is read once; v4 brings two p-values."""
    def row(df: DataFrame, version: str, unit: str, *tests: tuple[str, str]) -> DataFrame:
        both = F.array(*[F.struct(F.lit(name).alias("test"), F.col(p).alias("p_value")) for name, p in tests])
        return df.select(F.lit(version).alias("version"), F.lit(unit).alias("unit"), F.explode(both).alias("r")).select("version", "unit", "r.*")

    out = row(v1, "v1", "zone", ("t-test (random)", "p_value"))
    for r in (row(v2, "v2", "zone", ("t-test (stratified)", "p_value")),
              row(v3, "v3", "zone", ("t-test (isolated)", "p_value")),
              row(v4, "v4", "zone", ("permutation (all)", "p_value_perm_all"), ("permutation (rest)", V4_P_REST)),
              row(v5, "v5", "trip", ("t-test", "p_value"))):
        out = out.unionByName(r)
    return out.withColumn("significant", F.col("p_value") < F.lit(alpha)).orderBy("version", "test")
