"""Statistics operators against brute-force numpy on collected small inputs."""
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from taxilens.operators import did, experiment as E, resample as R
from taxilens.plans import registry as Q


def row_level_hc3(panel_pdf):
    """Plain row-level OLS + HC3, the definition (no cell shortcut)."""
    months = sorted(panel_pdf["month"].unique())
    n = len(panel_pdf)
    cols = [np.ones(n)] + [(panel_pdf["month"] == m).to_numpy(float) for m in months[1:]]
    cols += [panel_pdf["post"].to_numpy(float), panel_pdf["treated"].to_numpy(float), panel_pdf["did"].to_numpy(float)]
    x = np.column_stack(cols)
    y = panel_pdf["log_trips"].to_numpy(float)
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ x.T @ y
    e = y - x @ beta
    h = np.einsum("ij,jk,ik->i", x, bread, x)
    meat = (x * (e ** 2 / (1 - h) ** 2)[:, None]).T @ x
    se = np.sqrt(np.diag(bread @ meat @ bread))
    r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    return beta, se, r2


def test_hc3_cells_equal_row_level(spark):
    panel = Q._panel(spark, SF_MID)
    pdf = panel.toPandas()
    beta, se, r2 = row_level_hc3(pdf)
    got = did.did_ols_hc3(did.did_cells(panel)).toPandas().set_index("term")
    months = sorted(pdf["month"].unique())
    got = got.loc[["Intercept", *(f"C(month)[T.{m}]" for m in months[1:]), "post", "treated", "did"]]
    np.testing.assert_allclose(got["coef"].to_numpy(), beta, rtol=1e-9, atol=1e-11)
    np.testing.assert_allclose(got["std_err"].to_numpy(), se, rtol=1e-8)
    assert got["r_squared"].iloc[0] == pytest.approx(r2, rel=1e-9)
    want = [math.erfc(abs(z) / math.sqrt(2)) for z in got["z"]]
    np.testing.assert_allclose(got["p_value"].to_numpy(), want, rtol=1e-12)


def test_hc3_of_a_collinear_panel_is_null(spark):
    cells = did.did_cells(Q._panel(spark, SF_MID).where("treated = 1"))
    got = {r.term: r for r in did.did_ols_hc3(cells).collect()}
    assert got["did"].coef is None and got["did"].p_value is None and got["Intercept"].n_obs > 0


def test_normal_two_sided(spark):
    from taxilens.functions.dist import normal_two_sided
    zs = [0.0, -1e-6, 0.3, -1.96, 4.0, 9.5, 25.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided("z").alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-12)


def test_did_summary_consistent_with_2x2(spark):
    panel = Q._panel(spark, SF_MID)
    s = did.did_summary(panel, 15).first()
    d = did.did_2x2(panel).first()
    assert s.did_effect_pct == float(np.round(d.did_pct, 2))
    assert s.cbd_demand_change_pct == float(np.round(d.cbd_change_pct, 2))


def test_did_summary_with_empty_cells(spark):
    panel = Q._panel(spark, SF_MID)
    s = did.summary_columns(panel.where("not (treated = 1 and post = 0)"), 15).first()
    assert s.did_effect_pct is None and s.cbd_demand_change_pct is None and s.noncbd_demand_change_pct is not None
    zero = did.summary_columns(panel.withColumn("avg_fare", F.lit(0.0)), 15).first()
    assert zero.did_fare_effect == 0.0


def welch_numpy(a, b):
    va, vb = a.var(ddof=1), b.var(ddof=1)
    se2 = va / len(a) + vb / len(b)
    t = (a.mean() - b.mean()) / math.sqrt(se2)
    df = se2 ** 2 / ((va / len(a)) ** 2 / (len(a) - 1) + (vb / len(b)) ** 2 / (len(b) - 1))
    return t, df


def test_welch_matches_numpy(spark):
    proj = Q._projected(spark, SF_MID)
    pdf = proj.toPandas()
    c = pdf.loc[pdf.group == "control", "sim_trips"].to_numpy(float)
    t = pdf.loc[pdf.group == "treatment", "sim_trips"].to_numpy(float)
    w = E.with_inference(E.welch_overall(proj)).first()
    tt, df = welch_numpy(c, t)
    assert w.t_stat == pytest.approx(tt, rel=1e-9)
    assert w.df == pytest.approx(df, rel=1e-9)
    pooled = math.sqrt((c.std() ** 2 + t.std() ** 2) / 2)
    assert w.cohens_d == pytest.approx((c.mean() - t.mean()) / pooled, rel=1e-9)
    from taxilens.functions.dist import t_ppf_scalar
    q = t_ppf_scalar(0.975, len(t) - 1)
    sem = t.std(ddof=1) / math.sqrt(len(t))
    assert w.ci_lower == pytest.approx(t.mean() - q * sem, rel=1e-9)


def test_stratified_arms_balanced_per_tier(spark):
    a = E.stratified_design(Q._baseline(spark, SF_MID)).toPandas()
    for _, g in a.groupby("tier"):
        nc = (g.group == "control").sum()
        nt = (g.group == "treatment").sum()
        assert nc == len(g) // 2 and nt - nc in (0, 1)


def test_trip_arms_split_zone_pairs(spark):
    t = E.assign_trips(Q.yellow(spark, SF_MID)).groupBy("pickup_zone", "dropoff_zone").agg(
        F.count_distinct("group").alias("arms"), F.count(F.lit(1)).alias("n")).where("n >= 8")
    assert t.where("arms = 2").count() >= 0.95 * t.count()


def test_assignment_invariant_under_repartition(spark):
    base = Q._baseline(spark, SF_MID)
    a = {r.pickup_zone: r.group for r in E.stratified_design(base).collect()}
    b = {r.pickup_zone: r.group for r in E.stratified_design(base.repartition(7)).collect()}
    assert a == b
    y = Q.yellow(spark, SF_SMALL)
    t1 = E.assign_trips(y).groupBy("group").count().orderBy("group").collect()
    t2 = E.assign_trips(y.repartition(5)).groupBy("group").count().orderBy("group").collect()
    assert t1 == t2


def test_unequal_tier_split(spark):
    df = spark.createDataFrame([(z, "small") for z in range(1, 6)], "pickup_zone int, tier string")
    g = E.assign_stratified(df).groupBy("group").count().orderBy("group").collect()
    assert [(r.group, r["count"]) for r in g] == [("control", 2), ("treatment", 3)]


def test_tiers_use_linear_quantiles(spark):
    base = Q._baseline(spark, SF_MID)
    pdf = base.toPandas()
    q75, q25 = pdf.total_trips.quantile(0.75), pdf.total_trips.quantile(0.25)
    want = {z: ("large" if v >= q75 else "medium" if v >= q25 else "small")
            for z, v in zip(pdf.pickup_zone, pdf.total_trips)}
    got = {r.pickup_zone: r.tier for r in E.with_tier(base).collect()}
    assert got == want


def rank_of(x, n, r, seed, purpose=1):
    """The keyed bijection in plain Python."""
    side = max(1, math.isqrt(n))
    _, a = min((-n % a, a) for a in range(side, 2 * side + 1))
    b = -(-n // a)
    while True:
        s = [x // b, x % b]
        for j, (f, g) in enumerate(R.round_factors(seed, purpose)):
            k = (r * f + g) % R.PRIME
            t = (s[1 - j % 2] + 1) * k % R.PRIME
            s[j % 2] = (s[j % 2] + (t * t + k) % R.PRIME) % (a, b)[j % 2]
        x = s[0] * b + s[1]
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 13, 40, 47, 229, 1009])
def test_ranks_are_a_bijection(spark, n):
    """Every replicate's ranks are 0..n-1, those of the plain version; sizes
    without a tight grid make indexes walk over spare cells."""
    units = R.with_grid(spark.range(n).selectExpr("id AS index", f"{n}L AS units"), "units")
    rows = R.permuted(units.crossJoin(spark.range(6).withColumnRenamed("id", "r")), "index", "units", "r", 7)
    got = {(r, i): k for r, i, k in rows.select("r", "index", "rank").collect()}
    for r in range(6):
        assert sorted(got[r, i] for i in range(n)) == list(range(n))
        assert [got[r, i] for i in range(n)] == [rank_of(i, n, r, 7) for i in range(n)]


def test_ranks_look_random(spark):
    """Over replicates each unit, and each pair, is in the first half as often as it should be."""
    n, reps = 41, 4000
    units = R.with_grid(spark.range(n).selectExpr("id AS index", f"{n}L AS units"), "units")
    rows = R.permuted(R._replicated(units, reps), "index", "units", "r", 3).select("r", "index", "rank").toPandas()
    m = rows.pivot(index="r", columns="index", values="rank").to_numpy() < 20
    assert np.abs(m.mean(axis=0) - 20 / n).max() < 5 * math.sqrt(0.25 / reps)
    pairs = (m.T.astype(float) @ m) / reps
    off = pairs[~np.eye(n, dtype=bool)]
    assert np.abs(off - 20 * 19 / (n * (n - 1))).max() < 5.5 * math.sqrt(0.19 / reps)


def test_permutation_plan_sorts_no_replicate(spark):
    plan = R.permutation_diffs(Q._projected(spark, SF_SMALL), n=50)._jdf.queryExecution().executedPlan().toString()
    ordered = [line for line in plan.splitlines() if re.search(r"\b(Window|Sort) \[", line)]
    assert ordered and not any(re.search(r"\br#", line) for line in ordered)


def test_permutation_and_bootstrap_reproducible_and_exact(spark):
    proj = Q._projected(spark, SF_MID)
    a = R.permutation_diffs(proj, n=700).orderBy("replicate").toPandas()
    b = R.permutation_diffs(proj.repartition(5), n=700).orderBy("replicate").toPandas()
    np.testing.assert_allclose(a["diff"].to_numpy(), b["diff"].to_numpy(), rtol=1e-12)
    pdf = proj.toPandas().sort_values("pickup_zone")
    zones, values = pdf.pickup_zone.tolist(), dict(zip(pdf.pickup_zone, pdf.sim_trips.astype(float)))
    arms = {g: pdf.loc[pdf.group == g, "pickup_zone"].tolist() for g in ("control", "treatment")}
    mean = lambda zs: np.mean([values[z] for z in zs])
    (f, g), = R.round_factors(42, 2, 1)
    perm, boot = [], []
    for r in range(700):
        ranks = [rank_of(i, len(zones), r, 42) for i in range(len(zones))]
        n_t = len(arms["treatment"])
        perm.append(mean([z for z, k in zip(zones, ranks) if k < n_t]) - mean([z for z, k in zip(zones, ranks) if k >= n_t]))
        k = (r * f + g) % R.PRIME
        slot = lambda z, size: (((zones.index(z) + 1) * k % R.PRIME) ** 2 + k) % R.PRIME % size
        drawn = {arm: [zs[slot(z, len(zs))] for z in zs] for arm, zs in arms.items()}
        boot.append(mean(drawn["treatment"]) - mean(drawn["control"]))
    np.testing.assert_allclose(a["diff"].to_numpy(), perm, rtol=1e-9, atol=1e-6)
    obs = mean(arms["treatment"]) - mean(arms["control"])
    p_val = R.permutation_test(proj, n=700).first().p_value
    assert p_val == pytest.approx(np.mean(np.abs(perm) >= abs(obs) * (1 - 1e-9)))
    ci = R.bootstrap_ci(proj, n=700).first()
    assert ci.ci_lower == pytest.approx(np.percentile(boot, 2.5)) and ci.ci_upper == pytest.approx(np.percentile(boot, 97.5))


def test_poisson_bootstrap_on_trips(spark):
    trips = Q._trips(spark, SF_MID)
    got = R.poisson_bootstrap(trips, value="sim_fare", identity=E.trip_identity(), n=100).first()
    w = E.trip_welch(trips).first()
    assert got.observed_diff == pytest.approx(w.fare_difference, rel=1e-9) and got.n_bootstraps == 100
    assert 0.7 < got.boot_se / abs(w.fare_difference / w.t_stat) < 1.3
    assert got.ci_lower < got.observed_diff < got.ci_upper


def test_permutation_null_roughly_uniform(spark):
    # Under the null (no simulated effect) p-values of different seeds are spread out.
    base = Q._baseline(spark, SF_MID)
    ps = []
    for seed in range(8):
        d = E.scenario_projection(E.stratified_design(base, seed=seed), effect=1.0, multiplier=1.0)
        ps.append(R.permutation_test(d, n=200, seed=seed).first().p_value)
    assert min(ps) < 0.6 and max(ps) > 0.2


def test_prop_ztest_matches_formula(spark):
    trips = Q._trips(spark, SF_SMALL)
    pdf = trips.select("group", "sim_fare").toPandas()
    c = pdf[pdf.group == "control"].sim_fare > 25
    t = pdf[pdf.group == "treatment"].sim_fare > 25
    pp = (c.sum() + t.sum()) / (len(c) + len(t))
    se = math.sqrt(pp * (1 - pp) * (1 / len(c) + 1 / len(t)))
    got = E.prop_ztest(trips).first()
    assert got.z_stat == pytest.approx((t.mean() - c.mean()) / se, rel=1e-9)


def test_sample_exact_equals_brute_force(spark):
    from taxilens.operators.sampling import hash_unit, sample_exact
    y = Q.yellow(spark, SF_MID).where("year = 2024")
    keys = ["pickup_time", "pickup_zone", "dropoff_zone", "fare_amount", "trip_distance"]
    for n, bins in ((500, 64), (2000, 4096), (10 ** 9, 16)):
        got = sample_exact(y, n, keys=keys, seed=7, bins=bins)
        want = y.withColumn("u", hash_unit(7, keys)).orderBy("u", *y.columns).limit(min(n, y.count())).drop("u")
        assert got.count() == min(n, y.count())
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ["did_summary", "ab_test_result", "forecast_2026", "kpi_summary"])
def test_rollup_path_equals_direct_path(spark, name):
    direct = Q.QUERIES[name](spark, SF_MID).collect()
    rolled = Q.QUERIES[f"{name}__rollup"](spark, SF_MID).collect()
    assert len(direct) == len(rolled)
    for a, b in zip(direct, rolled):
        for x, y in zip(a, b):
            if isinstance(x, float):
                assert x == pytest.approx(y, rel=1e-9, abs=1e-9)
            else:
                assert x == y


def test_rollup_is_small(spark):
    r = Q.rollup(spark, SF_MID)
    trips = Q.yellow(spark, SF_MID).count()
    assert r.count() < trips and r.agg(F.sum("n")).first()[0] == trips


def test_sample_exact_collapses_copies(spark):
    from taxilens.operators.sampling import hash_unit, sample_exact
    base = spark.range(0, 3000).selectExpr("id", "id % 7 AS g")
    copies = spark.range(0, 2000).selectExpr("-1 AS id", "0 AS g")     # one row repeated 2000 times
    df = base.unionByName(copies)
    for n in (10, 1500, 4000, 5000, 6000):
        got = sample_exact(df, n, keys=["id", "g"], seed=3, bins=8)
        want = df.withColumn("u", hash_unit(3, ["id", "g"])).orderBy("u", "id", "g").limit(min(n, 5000)).drop("u")
        assert got.count() == min(n, 5000)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
