"""Permutation test and bootstrap intervals.

Zone level: replicate ids are exploded on the units, one row per unit and
replicate, and what follows is a map and one partial aggregate by replicate.
A unit's rank under a replicate's permutation is computed from its own index
by a keyed bijection of 0..n-1 (:func:`permuted`), so nothing is sorted; the
first n_t ranks are the treated.  A bootstrap draw is a unit slot whose hash
picks another unit of its arm.  All keys are integer arithmetic modulo a
prime, so replicates do not depend on partitions or retries, and a SQL oracle
repeats them.  No task holds more than its chunk of replicates at a time.

Trip level: :func:`poisson_bootstrap` gives every row a Poisson(1) weight
per replicate, summed with map-side combine; only one row per replicate and
arm is shuffled, however many trips there are.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .experiment import CONTROL, TREATMENT, V4_P_REST, V4_SIG_REST

N_REPLICATES = 10_000
N_TRIP_REPLICATES = 200
#: Differences that equal the observed one up to summation order count as equal.
TIE = 1e-9
PRIME = (1 << 31) - 1


#: Half rounds of the bijection, and what each mixes with.
ROUNDS = 6
#: Replicates whose rows one task makes.
CHUNK = 320


def round_factors(seed: int, purpose: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two factors below PRIME for each round."""
    def factor(j: int, k: int) -> int:
        return 1 + int(hashlib.md5(f"{seed}|{purpose}|{j}|{k}".encode()).hexdigest()[:13], 16) % (PRIME - 1)
    return [(factor(j, 0), factor(j, 1)) for j in range(rounds)]


def _round_key(r: Column, factors: tuple[int, int]) -> Column:
    return (r * F.lit(factors[0]) + F.lit(factors[1])) % F.lit(PRIME)


def with_grid(units: DataFrame, n: str) -> DataFrame:
    """Adds grid_a, grid_b: sides of the tightest grid of at least ``n`` cells
    whose first side lies between the root of n and twice that."""
    side = F.greatest(F.lit(1), F.floor(F.sqrt(F.col(n))))
    best = F.array_min(F.transform(F.sequence(side, side * 2), lambda a: F.struct((F.pmod(-F.col(n), a)).alias("spare"), a.alias("a"))))
    return units.withColumn("grid_a", best["a"]).withColumn("grid_b", F.ceil(F.col(n) / F.col("grid_a")).cast("long"))


def permuted(rows: DataFrame, index: str, n: str, replicate: str, seed: int, out: str = "rank") -> DataFrame:
    """Adds ``out``: where the permutation of ``replicate`` puts ``index`` of
    0..n-1.  Needs the columns of :func:`with_grid`.

    A cell (l, r) of the grid goes through Feistel rounds: one side is moved,
    modulo its length, by a function of the other side and the replicate's
    round key, so the grid's cells are permuted whatever the function.  An
    index that lands on a spare cell goes through the rounds again until it
    lands below n (cycle walking); it meets each spare cell once at most, so
    as many repetitions as there are spare cells are enough.
    """
    factors = round_factors(int(seed), 1)
    a, b, r = F.col("grid_a"), F.col("grid_b"), F.col(replicate)

    # the first pass as columns, each used by the next
    rows = rows.withColumns({"__l": F.floor(F.col(index) / b).cast("long"), "__r": F.col(index) % b})
    for j, f in enumerate(factors):
        move, other, side = ("__l", "__r", a) if j % 2 == 0 else ("__r", "__l", b)
        rows = rows.withColumn("__k", _round_key(r, f))
        rows = rows.withColumn("__t", (F.col(other) + 1) * F.col("__k") % F.lit(PRIME))
        rows = rows.withColumn(move, (F.col(move) + (F.col("__t") * F.col("__t") + F.col("__k")) % F.lit(PRIME)) % side)
    rows = rows.withColumn(out, F.col("__l") * b + F.col("__r"))

    # the rounds again, as one expression, for what landed on a spare cell
    def let(value: Column, fn) -> Column:
        return F.element_at(F.transform(F.array(value), fn), 1)

    def again(x: Column) -> Column:
        def step(j: int, left: Column, right: Column) -> Column:
            if j == len(factors):
                return left * b + right
            move, other, side = (left, right, a) if j % 2 == 0 else (right, left, b)
            k = _round_key(r, factors[j])
            mixed = let((other + 1) * k % F.lit(PRIME), lambda t: (move + (t * t + k) % F.lit(PRIME)) % side)
            return let(mixed, lambda m: step(j + 1, m, right) if j % 2 == 0 else step(j + 1, left, m))
        return step(0, F.floor(x / b).cast("long"), x % b)

    spare = F.array_repeat(F.lit(0), (a * b - F.col(n)).cast("int"))
    walked = F.aggregate(spare, F.col(out), lambda x, _: F.when(x < F.col(n), x).otherwise(again(x)))
    return rows.withColumn(out, F.when(F.col(out) < F.col(n), F.col(out)).otherwise(walked)).drop("__l", "__r", "__k", "__t")


def _indexed(units: DataFrame, value: str, arm: str, unit: str) -> DataFrame:
    """(arm, value, index, units, n_t, slot, size, observed_diff): one row per
    unit; the windows run over the units, before they are replicated."""
    v = F.col(value).cast("double")
    whole, of_arm = Window.partitionBy(), Window.partitionBy("arm")
    base = units.select(F.col(unit).cast("long").alias("unit"), F.col(arm).alias("arm"), v.alias("value"))
    base = base.withColumns({
        "observed_diff": F.avg(F.when(F.col("arm") == TREATMENT, F.col("value"))).over(whole) - F.avg(F.when(F.col("arm") == CONTROL, F.col("value"))).over(whole),
        "units": F.count(F.lit(1)).over(whole), "n_t": F.count_if(F.col("arm") == TREATMENT).over(whole),
        "index": (F.row_number().over(whole.orderBy("unit")) - 1).cast("long")})
    return base.withColumns({"slot": (F.row_number().over(of_arm.orderBy("unit")) - 1).cast("long"), "size": F.count(F.lit(1)).over(of_arm)})


def _replicated(base: DataFrame, n: int) -> DataFrame:
    """``base`` with ``r`` in 0..n-1 for each row, dealt to tasks by chunks of replicates."""
    chunks = -(-n // CHUNK)
    dealt = base.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(chunks, "chunk")
    last = F.least(F.lit(n), (F.col("chunk") + 1) * CHUNK) - 1
    return dealt.withColumn("r", F.explode(F.sequence((F.col("chunk") * CHUNK).cast("long"), last.cast("long")))).drop("chunk")


def permutation_diffs(units: DataFrame, *, value: str = "sim_trips", arm: str = "group",
                      unit: str = "pickup_zone", n: int = N_REPLICATES, seed: int = 42) -> DataFrame:
    """(replicate, diff, observed_diff): mean(treatment) - mean(control) under relabelling."""
    base = with_grid(_indexed(units, value, arm, unit), "units")
    rows = permuted(_replicated(base, n), "index", "units", "r", seed)
    treated = F.col("rank") < F.col("n_t")
    return rows.groupBy(F.col("r").alias("replicate")).agg(
        (F.avg(F.when(treated, F.col("value"))) - F.avg(F.when(~treated, F.col("value")))).alias("diff"),
        F.first("observed_diff").alias("observed_diff"))


def bootstrap_diffs(units: DataFrame, *, value: str = "sim_trips", arm: str = "group",
                    unit: str = "pickup_zone", n: int = N_REPLICATES, seed: int = 42) -> DataFrame:
    """(replicate, diff, observed_diff) of resampled mean(treatment) - mean(control).

    Every draw finds its unit, so the left join loses nothing; it leaves the
    units, never the draws, to be broadcast where Catalyst knows them to be few.
    """
    slots = _indexed(units, value, arm, unit)
    draws = _replicated(slots.select("arm", "index", "size", "observed_diff"), n)
    (f, g), = round_factors(int(seed), 2, 1)
    k = _round_key(F.col("r"), (f, g))
    t = (F.col("index") + 1) * k % F.lit(PRIME)
    draws = draws.withColumn("t", t).withColumn("slot", ((F.col("t") * F.col("t") + k) % F.lit(PRIME)) % F.col("size"))
    drawn = draws.select("r", "arm", "slot", "observed_diff").join(slots.select("arm", "slot", "value"), ["arm", "slot"], "left")
    return drawn.groupBy(F.col("r").alias("replicate")).agg(
        (F.avg(F.when(F.col("arm") == TREATMENT, F.col("value"))) - F.avg(F.when(F.col("arm") == CONTROL, F.col("value")))).alias("diff"),
        F.first("observed_diff").alias("observed_diff"))


def observed_diff(units: DataFrame, *, value: str = "sim_trips", arm: str = "group") -> DataFrame:
    v = F.col(value).cast("double")
    return units.agg((F.avg(F.when(F.col(arm) == TREATMENT, v))
                      - F.avg(F.when(F.col(arm) == CONTROL, v))).alias("observed_diff"))


def permutation_test(units: DataFrame, *, corrected: bool = False, **kw) -> DataFrame:
    """X11: two-sided permutation p-value, share of |perm| >= |observed|.

    The reference has no +1 correction; ``corrected=True`` gives
    (k + 1) / (R + 1).
    """
    reps = permutation_diffs(units, **kw)
    hit = F.abs("diff") >= F.abs("observed_diff") * F.lit(1 - TIE)
    agg = reps.agg(F.first("observed_diff").alias("observed_diff"), F.count(F.lit(1)).alias("n_permutations"),
                   F.count_if(hit).cast("double").alias("_k"))
    p = (F.col("_k") + 1) / (F.col("n_permutations") + 1) if corrected else F.col("_k") / F.col("n_permutations")
    return agg.select("observed_diff", "n_permutations", p.alias("p_value"))


def _interval(reps: DataFrame, level: float) -> DataFrame:
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    s = reps.agg(F.first("observed_diff").alias("observed_diff"), F.count(F.lit(1)).alias("n_bootstraps"),
                 F.percentile("diff", lo).alias("ci_lower"), F.percentile("diff", hi).alias("ci_upper"),
                 F.stddev_pop("diff").alias("boot_se"))
    return s.select(
        "observed_diff", "n_bootstraps", "ci_lower", "ci_upper", "boot_se",
        F.when(F.col("boot_se") > 0, F.col("observed_diff") / F.col("boot_se")).otherwise(F.lit(0.0))
         .alias("effect_over_se"),
        ((F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0)).alias("ci_includes_zero"))


def bootstrap_ci(units: DataFrame, *, level: float = 0.95, **kw) -> DataFrame:
    """Percentile interval of the difference, bootstrap SE and effect / SE."""
    return _interval(bootstrap_diffs(units, **kw), level)


def replicate_factors(n: int, seed: int) -> list[tuple[int, int]]:
    """Two factors below PRIME for each replicate: weights come from
    (a * row key + b) mod PRIME, one multiplication per row and replicate."""
    def factor(r: int, k: int) -> int:
        return 1 + int(hashlib.md5(f"{seed}|3|{r}|{k}".encode()).hexdigest()[:13], 16) % (PRIME - 1)
    return [(factor(r, 0), factor(r, 1)) for r in range(n)]


def poisson_weight(u: Column) -> Column:
    """Poisson(1) by inversion of a uniform value, exact up to 1e-9 of its mass."""
    weight, mass, term = F.lit(0), 0.0, math.exp(-1.0)
    for k in range(12):
        mass += term
        term /= k + 1
        weight = weight + (u >= F.lit(mass)).cast("int")
    return weight


def poisson_diffs(trips: DataFrame, *, value: str, identity: list[Column | str], arm: str = "group",
                  n: int = N_TRIP_REPLICATES, seed: int = 42) -> DataFrame:
    """(replicate, diff, observed_diff) from Poisson-weighted rows."""
    v = F.col(value).cast("double")
    factors = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                        for r, (a, b) in enumerate(replicate_factors(n, seed))])
    base = trips.where(F.col(arm).isin(CONTROL, TREATMENT)).select(
        F.col(arm).alias("arm"), v.alias("value"), (X.hash_key(int(seed), *identity) % F.lit(PRIME)).alias("key"))
    obs = observed_diff(base.withColumnRenamed("arm", arm), value="value", arm=arm).scalar()
    rows = base.withColumn("f", F.explode(factors))
    u = ((F.col("key") * F.col("f.a") + F.col("f.b")) % F.lit(PRIME)) / F.lit(float(PRIME))
    rows = rows.select("arm", "value", F.col("f.r").alias("r"), poisson_weight(u).alias("w"))
    sums = rows.groupBy("r", "arm").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("value")).alias("s"))
    by_r = sums.groupBy(F.col("r").cast("long").alias("replicate")).agg(
        F.sum(F.when(F.col("arm") == TREATMENT, F.col("s") / F.col("n"))).alias("t"),
        F.sum(F.when(F.col("arm") == CONTROL, F.col("s") / F.col("n"))).alias("c"))
    return by_r.select("replicate", (F.col("t") - F.col("c")).alias("diff"), obs.alias("observed_diff"))


def poisson_bootstrap(trips: DataFrame, *, value: str, identity: list[Column | str], level: float = 0.95, **kw) -> DataFrame:
    """X12 on trips: interval of the difference of means without one array or task per arm."""
    return _interval(poisson_diffs(trips, value=value, identity=identity, **kw), level)


def v4_result(projected: DataFrame, projected_rest: DataFrame, *, revenue_uplift: DataFrame,
              alpha: float = 0.05, n: int = N_REPLICATES, seed: int = 42,
              rest_group: str = "group_v3") -> DataFrame:
    """The 11-column v4 result (permutation + bootstrap, all zones and the rest)."""
    from ..functions.frames import one_row
    p_all = permutation_test(projected, n=n, seed=seed).select(
        "observed_diff", "n_permutations", F.col("p_value").alias("p_all"))
    p_rest = permutation_test(projected_rest, arm=rest_group, n=n, seed=seed).select(
        F.col("p_value").alias("p_rest"))
    ci = bootstrap_ci(projected, n=n, seed=seed).select("ci_lower", "ci_upper")
    r = lambda c, d: X.round_half_even(c, d)
    return one_row(p_all, p_rest, ci, revenue_uplift).select(
        F.lit("fee_increase_10pct_v4_bootstrap").alias("experiment"),
        F.lit("permutation_bootstrap").alias("test_method"),
        "n_permutations",
        r("observed_diff", 0).alias("observed_diff"),
        r("p_all", 4).alias("p_value_perm_all"), r("p_rest", 4).alias(V4_P_REST),
        r("ci_lower", 0).alias("ci_lower"), r("ci_upper", 0).alias("ci_upper"),
        (F.col("p_all") < alpha).alias("significant_all"), (F.col("p_rest") < alpha).alias(V4_SIG_REST),
        r("revenue_uplift", 0).alias("revenue_uplift_usd"))
