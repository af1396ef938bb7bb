"""Live demand marts on an event stream (A2, A11): event-time windows with a
watermark.

``demand`` counts events and averages their value per window and key in a
Structured Streaming aggregate.  A window is given out once, when the
watermark (the latest event time seen, less the allowed delay) has passed its
end; until then its counts are in the state store, which the checkpoint
covers.  Events of a window that was given out are late: they change nothing,
and :func:`run` writes how many there were.

Spark drops late rows by the watermark that the batch before went by, so a
row is late in batch b if its window had ended by
``max(event time in batches before b - 1) - delay``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import exprs as X
from ..sources import catalog
from ..sources.materialize import write_partitioned

DELAY = "1 day"
#: Row groups of a landed file, so that many tasks read it.
LANDED_ROW_GROUP_BYTES = 8 << 20
_PARTITIONS = "spark.sql.shuffle.partitions"


def demand(events: DataFrame, *, keys: Sequence[str], every: str, delay: str = DELAY, ts: str = "ts", value: str = "value") -> DataFrame:
    """(start, keys.., events, value_sum) per window of ``every``; streaming or
    batch (where no row is late)."""
    watched = events.withWatermark(ts, delay) if events.isStreaming else events
    out = watched.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("value_sum"))
    return out.select(F.col("w.start").alias("start"), *keys, "events", "value_sum")


def land(arrivals: DataFrame, at: str, landing: str) -> None:
    """The rows of ``arrivals`` as landed files, one a batch in the order of
    ``batch``.  The rows are read once, into a folder per batch below ``at``;
    each file is then made of its own folder."""
    write_partitioned(arrivals, at, ["batch"])
    arrived = arrivals.sparkSession.read.schema(arrivals.schema).parquet(at)
    for b in sorted(r.batch for r in arrived.select("batch").distinct().collect()):
        rows = arrived.where(F.col("batch") == b).drop("batch").coalesce(1)
        rows.write.mode("append").option("parquet.block.size", LANDED_ROW_GROUP_BYTES).parquet(landing)


def run(spark: SparkSession, landing: str, schema: StructType | str, out: str, checkpoint: str, *, keys: Sequence[str], every: str,
        delay: str = DELAY, files_per_batch: int = 1, ts: str = "ts", value: str = "value") -> StreamingQuery:
    """Work off what has landed (``availableNow``), a file a batch, and stop.
    Called again, it goes on from its checkpoint.  Closed windows are appended
    to ``out`` by Spark's own sink, each batch once.  The state, counts of the
    windows that are open, has a part a core at most when it is begun: each
    part costs every batch a task and a commit."""
    parts = spark.conf.get(_PARTITIONS)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    spark.conf.set(_PARTITIONS, min(int(parts), spark.sparkContext.defaultParallelism))
    try:
        q = (demand(stream, keys=keys, every=every, delay=delay, ts=ts, value=value).writeStream.format("parquet").outputMode("append")
             .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(_PARTITIONS, parts)
    q.awaitTermination()
    return q


def closed(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The windows given out so far; none before the first has closed."""
    return spark.read.schema(schema).parquet(out) if catalog.exists(spark, out) else spark.createDataFrame([], schema)


def peak_hours(windows: DataFrame, *, key: str) -> DataFrame:
    """A2 live: events per key and hour of day, against the key's mean hour."""
    hours = windows.groupBy(key, F.hour("start").alias("hour")).agg(F.sum("events").alias("events"), X.div(F.sum("value_sum"), F.sum("events")).alias("avg_value"))
    mean = hours.groupBy(F.col(key).alias("of")).agg(F.avg("events").alias("mean"))
    return hours.join(mean, F.col(key) == F.col("of")).select(key, "hour", "events", "avg_value",
                                                              X.div(F.col("events").cast("double"), "mean").alias("demand_index"))


def trend(windows: DataFrame) -> DataFrame:
    """A11 live: events, mean value and total per day."""
    return windows.groupBy(F.to_date("start").alias("day")).agg(
        F.sum("events").alias("events"), X.div(F.sum("value_sum"), F.sum("events")).alias("avg_value"), F.sum("value_sum").alias("total_value"))


def late_rows(batches: DataFrame, *, every: str, delay: str = DELAY, ts: str = "ts") -> DataFrame:
    """(batch, rows, late) from the landed rows with their batch number, by
    the rule above.  Batches are few; their latest times are aggregated first."""
    from pyspark.sql import Window
    top = batches.groupBy("batch").agg(F.max(ts).alias("top"))
    before = Window.partitionBy(F.lit(0)).orderBy("batch").rangeBetween(Window.unboundedPreceding, -2)
    mark = top.select(F.col("batch").alias("of"), (F.max("top").over(before) - F.expr(f"INTERVAL {delay}")).alias("mark"))
    rows = batches.join(F.broadcast(mark), F.col("batch") == F.col("of"))
    late = F.window(ts, every)["end"] <= F.col("mark")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(late, F.lit(False))).alias("late"))
