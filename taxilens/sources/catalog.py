"""Declared raw tables, partition projection and row-count checks.

The raw tables are Parquet folders partitioned by ``year``.  Reading goes
through the declared schema (no inference, column pruning from the start)
and, like the reference's partition projection, the partition paths are
generated from the declared year range instead of being listed.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEEDS, PARTITION_COLUMN, PARTITION_YEARS
from .materialize import hadoop_path


def partition_paths(base: str, years: Iterable[int] = PARTITION_YEARS) -> list[str]:
    """Projected partition folders ``base/year=Y`` for the declared range."""
    return [f"{base.rstrip('/')}/{PARTITION_COLUMN}={y}" for y in years]


def read_raw(spark: SparkSession, feed: str, base: str,
             years: Iterable[int] | None = None) -> DataFrame:
    """Read a landed raw table with its declared schema.

    With ``years`` only the projected folders of those years are opened,
    so the scan never lists or touches other partitions.  Folders that do
    not exist are skipped (a projected year may not have landed yet).  Of a
    table landed by batches only those with a commit marker are read.
    """
    schema = FEEDS[feed]["schema"]
    reader = spark.read.schema(schema).option("basePath", base)
    batches = marked_batches(spark, base)
    roots = [base] if batches is None else [f"{base.rstrip('/')}/{BATCH_COLUMN}={b}" for b in batches]
    paths = roots if years is None else [p for root in roots for p in partition_paths(root, years) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schema)
    return reader.parquet(*paths).select(*schema.fieldNames())


#: Where a table landed by batches keeps their folders and commit markers.
BATCH_COLUMN, MARKERS = "batch", "_batches"


def marked_batches(spark: SparkSession, base: str) -> list[str] | None:
    """The committed batches of a table landed by batches, one name each;
    None for a table that was not.  A batch counts once the job that wrote
    its file log has committed, which is after its rows."""
    fs, at = hadoop_path(spark, f"{base.rstrip('/')}/{MARKERS}")
    if not fs.exists(at):
        return None
    found = fs.globStatus(hadoop_path(spark, f"{base.rstrip('/')}/{MARKERS}/*/_SUCCESS")[1])
    return sorted(f.getPath().getParent().getName() for f in found or [])


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def declare_table(spark: SparkSession, name: str, feed: str, base: str) -> None:
    """``CREATE TABLE ... USING parquet PARTITIONED BY (year)`` over landed data."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in FEEDS[feed]["schema"].fields)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet "
              f"PARTITIONED BY ({PARTITION_COLUMN}) LOCATION '{base}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """SQL text in, lazy DataFrame out (DDL runs eagerly)."""
    return spark.sql(sql)


def partition_counts(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per feed and partition year."""
    out = None
    for feed, df in feeds.items():
        c = df.groupBy(PARTITION_COLUMN).agg(F.count(F.lit(1)).alias("trips")) \
              .select(F.lit(feed).alias("feed"), PARTITION_COLUMN, "trips")
        out = c if out is None else out.unionByName(c)
    return out


#: The folder of rows whose partition value is null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def partition_counts_footer(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """S8 from metadata: rows per feed and partition year out of the Parquet
    footers.  ``feeds``: :func:`drift.footers` of each feed's files.  Without
    one file's rows a count is wrong, so an unreadable footer is an error."""
    out = None
    bad = F.raise_error(F.concat_ws(": ", "path", "error"))
    for feed, files in feeds.items():
        files = files.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(bad))
        year = F.regexp_extract("path", f"/{PARTITION_COLUMN}=([^/]+)/", 1)
        year = F.when(year != NO_VALUE, year.cast("int"))
        c = files.groupBy(year.alias(PARTITION_COLUMN)).agg(F.sum("rows").alias("trips")).select(F.lit(feed).alias("feed"), PARTITION_COLUMN, "trips")
        out = c if out is None else out.unionByName(c)
    return out


def total_count(df: DataFrame) -> DataFrame:
    """One-row total."""
    return df.agg(F.count(F.lit(1)).alias("total"))
