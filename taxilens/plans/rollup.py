"""Rollup cells: one scan of the trips serving most marts.

Three tables of cells hold mergeable state, so cells of parts of the data
merge into cells of the whole, and marts read them through
``functions.measures`` (same mart code, re-aggregated):

``trips``  year x month x hour x era x zone (~51 x 24 x 265 ~ 324k cells at
           full scale; quarter and time bucket are functions of month and
           hour): ``n``, sums and counts of fare, fare per km, distance and
           fee, the fares' minimum, maximum and centred sum of squares
           (n, sum, M2 merge exactly: A3's volatility).  Serves A1-A3, A5, A6,
           A8-A12, A14-A21, A23, A27, A30.
``fares``  year x time bucket x zone x fare step: counts and sums (A4).
``waits``  year x zone x time bucket x platform x minute: counts (A25; 60
           whole minutes make an exact histogram for the percentiles).

Trip-level tests always read trips.

Each is a partial + final hash aggregate: a hot zone only adds rows to its
own cells, and the shuffle carries at most (tasks x cells) rows.

:func:`refresh` keeps the cells of a table landed by batches up to date: it
reads the new batches only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.measures import ROLLUP_KEYS, ROLLUP_MEASURES, merged_m2
from ..operators import silver
from ..operators.wait import WAIT_KEYS
from ..schemas import FEEDS
from ..sources import catalog
from ..sources.materialize import write_partitioned
from ..streaming import ingest

#: Width of a fare step of the ``fares`` cells, A4's default.
FARE_STEP = 5.0
FARE_KEYS = ("year", "time_bucket", "pickup_zone", "fare_bucket")
FARE_MEASURES = ("fare_amount", "trip_distance")
KEYS = {"trips": ROLLUP_KEYS, "fares": FARE_KEYS, "waits": (*WAIT_KEYS, "wait_time_minutes")}
#: The cells that are made of each feed.
FEED_KINDS = {"yellow": ("trips", "fares"), "fhv": ("waits",)}


def _sums(columns) -> list:
    return [a for c in columns for a in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]


def build_rollup(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``trips`` cells of a silver view."""
    fare = "fare_amount"
    return trips.groupBy(*by, *ROLLUP_KEYS).agg(
        F.count(F.lit(1)).alias("n"), *_sums(ROLLUP_MEASURES), F.min(fare).alias(f"{fare}_min"), F.max(fare).alias(f"{fare}_max"),
        (F.var_pop(fare) * F.count(fare)).alias(f"{fare}_m2"))


def build_fares(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``fares`` cells of a silver view."""
    trips = trips.withColumn("fare_bucket", X.bucket_floor("fare_amount", FARE_STEP))
    return trips.groupBy(*by, *FARE_KEYS).agg(F.count(F.lit(1)).alias("n"), *_sums(FARE_MEASURES))


def build_waits(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``waits`` cells of a silver view of the FHV feed."""
    return trips.groupBy(*by, *KEYS["waits"]).agg(F.count(F.lit(1)).alias("n"))


BUILD = {"trips": build_rollup, "fares": build_fares, "waits": build_waits}


def merge(kind: str, cells: DataFrame) -> DataFrame:
    """Cells of the whole from cells of its parts."""
    aggs = [F.sum("n").alias("n")]
    for c in cells.columns:
        if c.endswith(("_sum", "_n")):
            aggs.append(F.sum(c).alias(c))
        elif c.endswith("_min"):
            aggs.append(F.min(c).alias(c))
        elif c.endswith("_max"):
            aggs.append(F.max(c).alias(c))
        elif c.endswith("_m2"):
            aggs.append(F.greatest(F.lit(0.0), merged_m2(c.removesuffix("_m2"))).alias(c))
    return cells.groupBy(*KEYS[kind]).agg(*aggs)


def materialized(spark: SparkSession, kind: str, trips: DataFrame, relpath: str) -> DataFrame:
    """The cells written once (partitioned by year) under the checkpoint folder."""
    from ..sources.materialize import once
    return once(spark, relpath, lambda: BUILD[kind](trips),
                lambda p: spark.read.parquet(p), partition_by=("year",))


# ------------------------------------------------------ incremental refresh
RUN_SCHEMA = "batch string, version timestamp, run string"
SILVER = {"yellow": silver.silver_yellow, "fhv": silver.silver_fhv}


def _runs(spark: SparkSession, root: str) -> DataFrame:
    """(batch, version, run) of every batch's latest cells, of committed runs."""
    marked = catalog.marked_batches(spark, root)
    if not marked:
        return spark.createDataFrame([], RUN_SCHEMA)
    log = spark.read.schema(RUN_SCHEMA).parquet(*[f"{root}/{catalog.MARKERS}/{m}" for m in marked])
    return log.groupBy("batch").agg(F.max(F.struct("version", "run")).alias("last")).select("batch", "last.*")


def pending(spark: SparkSession, raw: str, root: str) -> DataFrame:
    """(batch, version) of the landed batches whose cells are missing or were
    made of rows that the batch has replaced since."""
    landed = ingest.file_log(spark, raw).groupBy("batch").agg(F.max("at").alias("version"))
    return landed.join(_runs(spark, root).select("batch", "version"), ["batch", "version"], "left_anti")


def new_trips(spark: SparkSession, feed: str, raw: str, batches: list[str]) -> DataFrame:
    """The silver rows of some landed batches, with their batch; only these are opened."""
    rows = spark.read.schema(FEEDS[feed]["schema"]).option("basePath", raw).parquet(*[f"{raw}/{catalog.BATCH_COLUMN}={b}" for b in batches])
    if catalog.BATCH_COLUMN not in rows.columns:  # not one row among them
        rows = rows.withColumn(catalog.BATCH_COLUMN, F.lit(None).cast("string"))
    return SILVER[feed](rows, year_from_partition=True, keep=(catalog.BATCH_COLUMN,))


def refresh(spark: SparkSession, feed: str, raw: str, root: str) -> list[str]:
    """Bring the cells under ``root`` up to the batches landed in ``raw``;
    returns the batches that were read.

    Each batch has cells of its own, so a batch that was landed again takes
    the place of its old contribution: nothing is subtracted, which minima
    and maxima would not allow.  A run writes its cells first and then its
    log, whose committed job makes it count; a run that is stopped leaves
    cells that nobody reads.
    """
    todo = pending(spark, raw, root).collect()  # a row per new batch
    if not todo:
        return []
    run = f"run-{uuid.uuid4().hex[:12]}"
    names = sorted(r.batch for r in todo)
    trips = new_trips(spark, feed, raw, names)
    for kind in FEED_KINDS[feed]:
        write_partitioned(BUILD[kind](trips, by=(catalog.BATCH_COLUMN,)), f"{root}/{kind}/{run}", [catalog.BATCH_COLUMN])
    log = spark.createDataFrame([(r.batch, r.version, run) for r in todo], RUN_SCHEMA)
    log.coalesce(1).write.parquet(f"{root}/{catalog.MARKERS}/{run}")
    return names


def cells(spark: SparkSession, kind: str, root: str) -> DataFrame:
    """The cells of all batches under ``root``, merged."""
    at = [f"{root}/{kind}/{r.run}/{catalog.BATCH_COLUMN}={r.batch}" for r in _runs(spark, root).collect()]
    return merge(kind, spark.read.parquet(*[p for p in at if catalog.exists(spark, p)]))
