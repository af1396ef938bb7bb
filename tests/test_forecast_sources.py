"""Forecast against a numpy fit; landing, drift repair and calendar."""
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from taxilens.operators import forecast as FC
from taxilens.plans import registry as Q
from taxilens.sources import catalog, drift, fixtures
from taxilens.streaming import ingest


def test_forecast_matches_numpy(spark):
    s = Q._series(spark, SF_MID)
    pdf = s.orderBy("ds").toPandas()
    t = np.array([d.year * 12 + d.month - 1 for d in pdf.ds], float)
    y = np.log(pdf.trip_count.to_numpy(float))
    b, a = np.polyfit(t, y, 1)
    r = y - (a + b * t)
    moy = np.array([d.month for d in pdf.ds])
    seas = {m: r[moy == m].mean() for m in range(1, 13)}
    sigma = np.std(r - np.array([seas[m] for m in moy]), ddof=1)
    got = FC.fit_forecast(s, "trip_count").orderBy("ds").toPandas()
    assert len(got) == 9 and str(got.ds.iloc[0]) == "2026-01-01"
    for i, row in got.iterrows():
        tf = t.max() + i + 1
        yh = a + b * tf + seas[row.ds.month]
        assert row.yhat == pytest.approx(math.exp(yh), rel=1e-8)
        assert row.upper == pytest.approx(math.exp(yh + 1.959963984540054 * sigma), rel=1e-8)


def test_bridge_series_duplicates_last_actual(spark):
    s = Q._series(spark, SF_SMALL)
    full = FC.bridge_series(FC.full_series(s, FC.forecast_table(s)))
    fc = full.where("type = 'forecast'").orderBy("ds").first()
    assert str(fc.ds) == "2025-12-01"
    assert full.count() == s.count() + 9 + 1


def test_backtest_equals_single_fits(spark):
    """Every origin of the city series against :func:`fit_forecast` trained on its months alone."""
    s = FC.monthly_series(Q.yellow(spark, SF_MID), years=(*FC.TRAIN_YEARS, 2026))
    got = {(str(r.ds), str(r.origin), r.length): r.forecast for r in FC.backtest(s, lengths=(24, 48), ahead=(1, 3)).collect()}
    for origin, length in (("2025-12-01", 48), ("2024-06-01", 24), ("2025-12-01", 24)):
        first = f"add_months(date'{origin}', {1 - length})"
        fit = FC.fit_forecast(s.where(f"ds BETWEEN {first} AND date'{origin}'"), "trip_count", horizon=3).orderBy("ds").collect()
        for h in (1, 3):
            assert got[str(fit[h - 1].ds), origin, length] == pytest.approx(fit[h - 1].yhat, rel=1e-9)
    assert {k[2] for k in got} == {24, 48} and len([k for k in got if k[2] == 48]) == 3 + 1


def test_changepoints_are_found_and_help(spark):
    """Planted breaks of the slope; a series without one; groups fitted side by side."""
    rng = np.random.default_rng(4)
    rows = []
    for zone, at in ((1, 30), (2, 18), (3, None)):
        for k in range(51):
            slope = 0.01 * k - (0.05 * max(0, k - at) if at else 0)
            rows.append((zone, f"{2022 + k // 12}-{k % 12 + 1:02d}-01", float(np.exp(8 + slope + 0.1 * np.sin(2 * np.pi * k / 12) + 0.004 * rng.normal()))))
    s = spark.createDataFrame(rows, "pickup_zone int, ds string, trip_count double").withColumn("ds", F.col("ds").cast("date"))
    train, held = s.where("ds < '2026-01-01'"), s.where("ds >= '2026-01-01'")
    bent = FC.changepoint_forecast(train, group=("pickup_zone",)).join(held, ["pickup_zone", "ds"])
    straight = FC.fit_forecast(train, "trip_count", group=("pickup_zone",)).join(held, ["pickup_zone", "ds"])
    off = lambda df: {r.pickup_zone: r.e for r in df.groupBy("pickup_zone").agg(F.avg(F.abs(F.col("yhat") / F.col("trip_count") - 1)).alias("e")).collect()}
    a, b = off(bent), off(straight)
    assert a[1] < 0.03 and a[2] < 0.03 and a[1] < b[1] / 5 and a[2] < b[2] / 5 and a[3] < 0.03
    last = {r.pickup_zone: r for r in bent.collect()}
    for zone, at in ((1, 30), (2, 18)):
        found = last[zone].last_break
        assert last[zone].n_breaks >= 1 and abs((found.year - 2022) * 12 + found.month - 1 - at) <= 3
    assert last[3].n_breaks == 0 and last[3].last_break is None


def test_changepoint_forecast_of_short_and_odd_series(spark):
    rows = [(1, "2024-01-01", 5.0), (2, "2024-01-01", 5.0), (2, "2024-02-01", 6.0), (3, "2024-01-01", None), (4, "2024-01-01", 0.0), (4, "2024-02-01", 3.0)]
    s = spark.createDataFrame(rows, "zone int, ds string, trip_count double").withColumn("ds", F.col("ds").cast("date"))
    out = FC.changepoint_forecast(s, group=("zone",), horizon=2).collect()
    assert sorted((r.zone, str(r.ds)) for r in out) == [(z, d) for z in (1, 2, 4) for d in (("2024-02-01", "2024-03-01") if z == 1 else ("2024-03-01", "2024-04-01"))]
    assert all(r.yhat > 0 and np.isfinite(r.yhat) for r in out)
    assert FC.changepoint_forecast(s.where("false"), horizon=2).count() == 0


def test_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    gram, corr = x.T @ x / 60, x.T @ rng.normal(size=60) / 60
    d = FC.coordinate_descent(gram, corr, 0.05, np.zeros(8))
    grad = corr - gram @ d
    assert np.all(np.abs(grad) <= 0.05 + 1e-7) and np.allclose(grad[d != 0], 0.05 * np.sign(d[d != 0]), atol=1e-7)


def test_ingest_twice_adds_nothing(spark, tmp_root):
    root = os.path.join(tmp_root, "ingest")
    li = fixtures.read_lineitem(spark, SF_SMALL)
    feed = fixtures.yellow_from_lineitem(li).drop("year")
    first = feed.where(F.year("tpep_pickup_datetime") <= 2024)
    second = feed.where(F.year("tpep_pickup_datetime") > 2024)
    landing, raw, ck = f"{root}/landing", f"{root}/raw", f"{root}/ck"
    first.write.mode("append").parquet(landing)
    ingest.land(spark, "yellow", landing, raw, ck)
    n1 = catalog.read_raw(spark, "yellow", raw).count()
    ingest.land(spark, "yellow", landing, raw, ck)
    assert catalog.read_raw(spark, "yellow", raw).count() == n1 == first.count()
    second.write.mode("append").parquet(landing)
    ingest.land(spark, "yellow", landing, raw, ck)
    assert catalog.read_raw(spark, "yellow", raw).count() == feed.count()
    # projected partitions: only the asked years are opened
    assert catalog.read_raw(spark, "yellow", raw, years=[2024]).select("year").distinct().collect()[0].year == 2024


def test_drift_repair_casts_and_nan_to_null(spark, tmp_root):
    base = os.path.join(tmp_root, "drift") + "/yellow"
    li = fixtures.read_lineitem(spark, SF_SMALL)
    d = fixtures.yellow_from_lineitem(li, drift=True)
    old = d.where("year <= 2023").withColumn(
        "passenger_count", F.when(F.col("passenger_count").isNull(), F.lit(float("nan"))).otherwise(F.col("passenger_count")))
    new = d.where("year >= 2024").withColumn("passenger_count", F.col("passenger_count").cast("long"))
    old.write.mode("append").partitionBy("year").parquet(base)
    new.write.mode("append").partitionBy("year").parquet(base)
    a = {r.year: r.action for r in drift.audit(spark, base).collect()}
    assert a[2022] == "fixed" and a[2024].startswith("skipped")
    fixed = drift.normalize_types(spark, base)
    assert dict(fixed.dtypes)["passenger_count"] == "bigint"
    want = d.count()  # every partition there is
    assert fixed.count() == want
    nulls = fixed.where("passenger_count is null").count()
    assert nulls == d.where("passenger_count is null").count()
    drift.rewrite(fixed, os.path.join(tmp_root, "fixed"))
    assert spark.read.parquet(os.path.join(tmp_root, "fixed")).count() == want


def test_calendar_and_missing_months(spark):
    raw = {"yellow": Q.raw_yellow(spark, SF_SMALL)}
    cov = ingest.month_coverage(spark, raw)
    assert cov.count() == 51
    gone = ingest.missing_months(spark, {"yellow": Q.raw_yellow(spark, SF_SMALL).where("month(tpep_pickup_datetime) <> 2")})
    assert gone.count() == 5   # February of 2022..2026


def test_sinks_and_mart_registry(spark, tmp_root):
    from taxilens.plans.marts import mart_registry, publish
    from taxilens.sources.sinks import read_mart_csv, write_mart
    y, f = Q.yellow(spark, SF_SMALL), Q.fhv(spark, SF_SMALL)
    assert len(mart_registry(fixtures.FIXTURE_TREATED_ZONES)) == 23
    tally = publish(spark, y, f, os.path.join(tmp_root, "marts"), fixtures.FIXTURE_TREATED_ZONES,
                    names={"kpi_summary", "monthly_trend", "did_summary"}).collect()
    assert {r.mart: r.status for r in tally} == {"kpi_summary": "ok", "monthly_trend": "ok", "did_summary": "ok"}
    p = write_mart(Q.QUERIES["monthly_trend"](spark, SF_SMALL), os.path.join(tmp_root, "csv_mt"), fmt="csv")
    back = read_mart_csv(spark, p)
    assert back.count() == 51 and "total_trips" in back.columns


def test_declared_table_and_table_load(spark, tmp_root):
    from taxilens.sources.sinks import load_table
    raw = Q.raw_yellow(spark, SF_SMALL)
    base = os.path.join(tmp_root, "declared", "yellow")
    raw.write.mode("overwrite").partitionBy("year").parquet(base)
    catalog.declare_table(spark, "yellow_trips", "yellow", base)
    got = {r.year: r.trips for r in spark.sql(
        "SELECT year, COUNT(*) AS trips FROM yellow_trips GROUP BY year").collect()}
    want = {r.year: r.trips for r in catalog.partition_counts({"yellow": raw}).collect()}
    assert got == want
    pruned = spark.sql("SELECT COUNT(*) FROM yellow_trips WHERE year = 2024")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan
    assert pruned.first()[0] == want[2024]
    n = load_table(spark, Q.QUERIES["kpi_summary"](spark, SF_SMALL), "kpi_summary_mart")
    assert n == 1 and spark.table("kpi_summary_mart").columns[0] == "total_zones"


def test_landing_keeps_good_files_and_names_bad_ones(spark, tmp_root):
    """Drifted types, a truncated file and one damaged in its middle."""
    from pyspark.sql import functions as F
    root = os.path.join(tmp_root, "landing-faults")
    landing, raw, ck = (os.path.join(root, x) for x in ("in", "raw", "ck"))
    feed = Q.raw_yellow(spark, SF_SMALL).drop("year")
    os.makedirs(landing)

    def put(name, df):
        part = os.path.join(root, "part-" + name)
        df.coalesce(1).write.parquet(part)
        src = next(os.path.join(part, f) for f in os.listdir(part) if f.endswith(".parquet"))
        with open(src, "rb") as f:
            data = f.read()
        with open(os.path.join(landing, name + ".parquet"), "wb") as f:
            f.write(data)
        return data

    whole = put("bigint", feed)
    put("double", feed.withColumn("passenger_count", F.col("passenger_count").cast("double")))
    with open(os.path.join(landing, "cut.parquet"), "wb") as f:
        f.write(whole[:len(whole) // 2])
    with open(os.path.join(landing, "hole.parquet"), "wb") as f:
        f.write(whole[:len(whole) // 3] + b"\xff" * 3000 + whole[len(whole) // 3 + 3000:])
    ingest.land(spark, "yellow", landing, raw, ck)
    n = feed.count()
    assert catalog.read_raw(spark, "yellow", raw).count() == 2 * n
    status = {os.path.basename(r.path): r.status for r in ingest.file_log(spark, raw).collect()}
    assert status == {"bigint.parquet": "landed", "double.parquet": "landed", "cut.parquet": "failed", "hole.parquet": "failed"}
    with open(os.path.join(landing, "cut.parquet"), "wb") as f:
        f.write(whole)
    ingest.land(spark, "yellow", landing, raw, ck)
    assert catalog.read_raw(spark, "yellow", raw).count() == 3 * n
    assert ingest.file_log(spark, raw).where("status = 'failed'").count() == 1


def test_landing_stopped_between_rows_and_marker(spark, tmp_root):
    """A batch whose rows are written but not marked is not seen, and lands once when repeated."""
    root = os.path.join(tmp_root, "landing-stop")
    landing, raw, ck = (os.path.join(root, x) for x in ("in", "raw", "ck"))
    feed = Q.raw_yellow(spark, SF_SMALL).drop("year")
    n = feed.count()
    feed.write.parquet(landing)
    mark = ingest.mark
    with pytest.MonkeyPatch.context() as m:
        def stop(*a):
            raise RuntimeError("driver lost")
        m.setattr(ingest, "mark", stop)
        with pytest.raises(Exception, match="driver lost"):
            ingest.land(spark, "yellow", landing, raw, ck)
    assert os.path.isdir(f"{raw}/batch=landed-00000000")
    assert ingest.file_log(spark, raw).count() == 0
    ingest.land(spark, "yellow", landing, raw, ck)
    assert catalog.read_raw(spark, "yellow", raw).count() == n
    # the batch once more, as after a stop behind the marker: it replaces its own folders
    paths = [r.path for r in ingest.file_log(spark, raw).collect()]
    ingest.land_files(spark, "yellow", paths, raw, "landed-00000000")
    assert ingest.mark is mark and catalog.read_raw(spark, "yellow", raw).count() == n
    # a file that failed is tried again under one name until its batch is marked
    with open(os.path.join(landing, "bad.parquet"), "wb") as f:
        f.write(b"no file")
    ingest.land(spark, "yellow", landing, raw, ck)
    ingest.land(spark, "yellow", landing, raw, ck)
    assert catalog.marked_batches(spark, raw) == ["landed-00000000", "landed-00000001", "retry-00000000"]
    assert catalog.read_raw(spark, "yellow", raw).count() == n
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest.land(spark, "yellow", landing, raw, ck + "-new")


def test_audit_of_many_small_files(spark, tmp_root):
    """10,000 files, by their footers in tasks; a damaged one is named."""
    base = os.path.join(tmp_root, "many")
    raw = Q.raw_yellow(spark, SF_SMALL).limit(10)
    kinds = {}
    for kind in ("double", "bigint"):
        part = os.path.join(tmp_root, "many-" + kind)
        raw.withColumn("passenger_count", F.col("passenger_count").cast(kind)).drop("year").coalesce(1).write.parquet(part)
        kinds[kind] = next(os.path.join(part, f) for f in os.listdir(part) if f.endswith(".parquet"))
    for year in range(2022, 2027):
        os.makedirs(f"{base}/year={year}")
        for k in range(2000):
            os.link(kinds["double" if year < 2024 else "bigint"], f"{base}/year={year}/{k}.parquet")
    with open(f"{base}/year=2022/bad.parquet", "wb") as f:
        f.write(b"PAR1 no footer PAR1")
    out = drift.audit(spark, base).groupBy("year", "found_type", "action").count().collect()
    assert sorted((r.year, r.found_type, r["count"]) for r in out if r.found_type) == [(y, "double" if y < 2024 else "bigint", 2000) for y in range(2022, 2027)]
    assert [(r.year, r.action) for r in out if not r.found_type] == [(2022, "error: ArrowInvalid")]
    foots = drift.footers(drift.files(spark, base)).where("error IS NULL")
    assert sum(len(places) for _, places in drift.readable_groups(foots)) == 5  # folders, not files
    assert {r.year: r.trips for r in catalog.partition_counts_footer({"yellow": foots}).collect()} == dict.fromkeys(range(2022, 2027), 20_000)


def test_counts_by_footer_of_a_damaged_file_are_an_error(spark, tmp_root):
    base = os.path.join(tmp_root, "damaged-count")
    spark.sql("SELECT id, 2022 + id % 2 AS year FROM range(10)").coalesce(1).write.partitionBy("year").parquet(base)

    def counts():
        return catalog.partition_counts_footer({"yellow": drift.footers(drift.files(spark, base))})

    assert sorted((r.year, r.trips) for r in counts().collect()) == [(2022, 5), (2023, 5)]
    with open(f"{base}/year=2022/bad.parquet", "wb") as f:
        f.write(b"PAR1 no footer PAR1")
    for use in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("year").collect()):
        with pytest.raises(Exception, match="year=2022/bad.parquet: ArrowInvalid"):
            use(counts())


def test_counts_by_footer_of_rows_without_a_year(spark, tmp_root):
    base = os.path.join(tmp_root, "no-year-count")
    spark.sql("SELECT id, CASE WHEN id > 2 THEN 2022 END AS year FROM range(10)").coalesce(1).write.partitionBy("year").parquet(base)
    out = catalog.partition_counts_footer({"yellow": drift.footers(drift.files(spark, base))}).collect()
    assert {r.year: r.trips for r in out} == {None: 3, 2022: 7}


def test_footers_from_a_store_that_only_spark_reads(spark, tmp_root, monkeypatch):
    base = os.path.join(tmp_root, "store")
    Q.raw_yellow(spark, SF_SMALL).write.partitionBy("year").parquet(base)
    by_range = drift.footers(drift.files(spark, base)).collect()
    monkeypatch.setattr(drift, "_opens", lambda path: False)
    whole = drift.footers(drift.files(spark, base)).collect()
    assert sorted(by_range) == sorted(whole) and all(r.error is None for r in whole)


def test_table_load_switches_at_once(spark, tmp_root):
    from taxilens.sources.sinks import load_table
    path = os.path.join(tmp_root, "switch")
    mart = spark.range(5).selectExpr("id", "id * 2 AS twice")
    assert load_table(spark, mart, "switched", path=path) == 5
    seen = spark.table("switched")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        load_table(spark, mart.selectExpr("id", "id DIV (id - 3) AS twice"), "switched", path=path)
    assert spark.table("switched").count() == 5
    assert load_table(spark, mart.where("id < 2"), "switched", path=path) == 2
    assert seen.count() == 5 and spark.table("switched").count() == 2  # who has begun reads on
    assert load_table(spark, mart.selectExpr("id"), "switched", path=path) == 5 and spark.table("switched").columns == ["id"]


def test_mixed_types_in_one_folder(spark, tmp_root):
    from pyspark.sql import functions as F
    base = os.path.join(tmp_root, "mixed")
    raw = Q.raw_yellow(spark, SF_SMALL)
    raw.withColumn("passenger_count", F.col("passenger_count").cast("double")).write.mode("append").partitionBy("year").parquet(base)
    raw.write.mode("append").partitionBy("year").parquet(base)
    kinds = {r.found_type for r in drift.audit(spark, base).collect()}
    assert kinds == {"double", "bigint"}
    out = drift.normalize_types(spark, base)
    assert out.count() == 2 * raw.count() and out.select("year").distinct().count() == raw.select("year").distinct().count()
    assert out.agg(F.sum("passenger_count")).first()[0] == 2 * raw.agg(F.sum("passenger_count")).first()[0]
