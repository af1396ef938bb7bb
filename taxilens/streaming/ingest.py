"""Incremental landing of monthly trip files into the year-partitioned raw
table (S1), and the feed calendar / coverage checks (S2).

The reference loops over 51 months x 2 feeds, skips files already present
and aborts a failed file, naming it, while the others continue.  Here a
Structured Streaming query over the *names* of the landing files finds new
ones (``trigger(availableNow=True)``; its checkpoint records what it has
seen), and each micro-batch lands its files whole or not at all:

* files are read by groups of equal types and conformed to the declared
  schema, so files whose types drifted land with all their rows;
* a file whose footer or data cannot be read lands no row.  It is named in
  the file log (:func:`file_log`) with its error, and tried again on the
  next call;
* output is partitioned by the *pickup* year, so the partition column equals
  the silver view's derived ``year``.

Landing is exactly once.  A batch writes its rows into a folder of its own,
named by its number, then its file log, whose committed job is the batch's
marker; readers (``catalog.read_raw``) take marked batches only.  The source
gives a batch that was interrupted the same files again, and it replaces its
own folders, whichever of the two had been written.  Files that failed
before are tried again in a batch named after the marked ones, so it, too, is
repeated under the same name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import catalog, drift
from ..sources.materialize import write_partitioned
from ..schemas import FEEDS, FHV_COLUMNS, PARTITION_COLUMN, YELLOW_COLUMNS

LANDING_COLUMNS = {"yellow": YELLOW_COLUMNS, "fhv": FHV_COLUMNS}

# Fixed calendar of the reference: 2022-01 .. 2026-03, two feeds.
CALENDAR_START = "2022-01-01"
CALENDAR_END = "2026-03-01"
FEED_NAMES = ("yellow", "fhv")


LOG_SCHEMA = "path string, status string, error string, rows long, at timestamp"


def file_log(spark: SparkSession, raw: str) -> DataFrame:
    """One row per landing file: its last status (landed or failed), error
    and the batch that tells so."""
    marked = catalog.marked_batches(spark, raw)
    if not marked:
        return spark.createDataFrame([], LOG_SCHEMA + ", batch string")
    log = spark.read.schema(LOG_SCHEMA).parquet(*[f"{raw}/{catalog.MARKERS}/{b}" for b in marked])
    log = log.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), f"/{catalog.MARKERS}/([^/]+)/", 1))
    last = F.max_by(F.struct("status", "error", "rows", "batch", "at"), F.struct("at", "batch"))
    return log.groupBy("path").agg(last.alias("s")).select("path", "s.*")


def _read_whole(file) -> dict:
    for _ in file.iter_batches():
        pass
    return {}


def write_rows(spark: SparkSession, feed: str, paths: list[str], raw: str, batch: str) -> DataFrame:
    """First half of a batch: the rows of its readable files, in the batch's
    own folder.  Returns the footers with the files' errors.  ``paths`` are
    the files of one batch, so few."""
    found = drift.files(spark, paths)
    foots = spark.createDataFrame(drift.footers(found).collect(), drift.FOOTER_SCHEMA)

    def write(good: DataFrame) -> None:
        rows = drift.read_groups(spark, drift.readable_groups(good, folders=False), LANDING_COLUMNS[feed])
        rows = rows.withColumn(PARTITION_COLUMN, F.year(FEEDS[feed]["pickup"]).cast("int"))
        write_partitioned(rows, f"{raw}/{catalog.BATCH_COLUMN}={batch}", [PARTITION_COLUMN], mode="overwrite")

    try:
        write(foots.where("error IS NULL"))
    except Exception:  # noqa: BLE001  some file is damaged beyond its footer
        damaged = drift.per_file(found, _read_whole, "path string, error string").where("error IS NOT NULL")
        damaged = spark.createDataFrame(damaged.collect(), "path string, damage string")
        more = foots.join(damaged, "path", "left").withColumn("error", F.coalesce("error", "damage")).drop("damage")
        if more.where("error IS NOT NULL").count() == foots.where("error IS NOT NULL").count():
            raise
        foots = more
        write(foots.where("error IS NULL"))
    return foots


def mark(foots: DataFrame, raw: str, batch: str) -> None:
    """Second half of a batch: its file log, whose commit makes it count."""
    log = foots.select("path", F.when(F.col("error").isNull(), F.lit("landed")).otherwise(F.lit("failed")).alias("status"), "error",
                       F.when(F.col("error").isNull(), F.col("rows")).alias("rows"), F.current_timestamp().alias("at"))
    log.coalesce(1).write.mode("overwrite").parquet(f"{raw}/{catalog.MARKERS}/{batch}")


def land_files(spark: SparkSession, feed: str, paths: list[str], raw: str, batch: str) -> None:
    """Land whole files as one batch, and log every one of them."""
    mark(write_rows(spark, feed, paths, raw, batch), raw, batch)


def land(spark: SparkSession, feed: str, landing: str, raw: str, checkpoint: str,
         *, files_per_batch: int = 64, wait: bool = True) -> StreamingQuery:
    """Land new files of ``feed`` from ``landing`` into ``raw`` (a folder per
    batch, partitioned by year), and those that failed before.  The table and
    the checkpoint, which numbers the batches, belong together."""
    marked = catalog.marked_batches(spark, raw)
    if marked and not catalog.exists(spark, checkpoint):
        raise ValueError(f"{raw} was landed with another checkpoint than {checkpoint}")
    again = sorted(r.path for r in file_log(spark, raw).where("status = 'failed'").select("path").collect())
    if again:
        retries = sum(b.startswith("retry-") for b in marked or [])
        land_files(spark, feed, again, raw, f"retry-{retries:08d}")

    def batch(names: DataFrame, number: int) -> None:
        paths = sorted(r.path for r in names.select("path").collect())  # files_per_batch at most
        if paths:
            land_files(names.sparkSession, feed, paths, raw, f"landed-{number:08d}")

    names = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).load(landing).select("path"))
    q = (names.writeStream.option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).foreachBatch(batch).start())
    if wait:
        q.awaitTermination()
    return q


def month_calendar(spark: SparkSession, start: str = CALENDAR_START, end: str = CALENDAR_END,
                   feeds=FEED_NAMES) -> DataFrame:
    """Feed x month-start calendar built with ``sequence``/``explode``."""
    feed_arr = ", ".join(f"'{f}'" for f in feeds)
    return spark.sql(
        f"SELECT feed, ds FROM (SELECT explode(array({feed_arr})) AS feed) "
        f"LATERAL VIEW explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 MONTH)) t AS ds")


def landed_months(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Trips per feed and pickup month actually present in the raw tables."""
    out = None
    for feed, df in raw.items():
        pickup = FEEDS[feed]["pickup"]
        m = (df.groupBy(F.trunc(F.to_date(pickup), "month").alias("ds"))
             .agg(F.count(F.lit(1)).alias("trips"))
             .withColumn("feed", F.lit(feed)))
        out = m if out is None else out.unionByName(m)
    return out


def month_coverage(spark: SparkSession, raw: Mapping[str, DataFrame], **kw) -> DataFrame:
    """Every calendar month per feed with its landed trip count (0 if missing)."""
    cal = month_calendar(spark, feeds=tuple(raw), **kw)
    got = landed_months(raw)
    j = cal.join(got, ["feed", "ds"], "left")
    return j.select("feed", "ds", F.coalesce(F.col("trips"), F.lit(0)).cast("long").alias("trips"),
                    F.col("trips").isNotNull().alias("landed")).orderBy("feed", "ds")


def missing_months(spark: SparkSession, raw: Mapping[str, DataFrame], **kw) -> DataFrame:
    """Calendar months with no landed trips: a left-anti join."""
    cal = month_calendar(spark, feeds=tuple(raw), **kw)
    return cal.join(landed_months(raw), ["feed", "ds"], "left_anti").orderBy("feed", "ds")
