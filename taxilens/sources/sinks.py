"""Mart sinks.

Marts are aggregates (rows bounded by zones x calendar), so a mart CSV is
written as a single file with a header, like the reference's exports.
Parquet is the default format.  The table sink writes the new rows to a place
of their own and then points the table there, so readers see the old table or
the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_mart(df: DataFrame, path: str, *, fmt: str = "parquet") -> str:
    """Overwrite ``path`` with the mart (CSV: one file with header)."""
    if fmt == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(fmt)
    return path


def read_mart_csv(spark: SparkSession, path: str) -> DataFrame:
    """S11 (CSV variant): reload an exported mart with inferred types."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def load_table(spark: SparkSession, df: DataFrame, name: str, *, path: str | None = None) -> int:
    """Replace the contents of a table by the DataFrame; return its row
    count.  The rows are written below ``path`` (by default, a folder beside
    the warehouse's tables) first, under a new name; the switch is one
    ``ALTER TABLE .. SET LOCATION``.  A load that fails leaves the table as it
    was, and what it held before is still there for readers who have begun.
    Only where the columns change is the table declared anew after the rows
    have been written: for a moment there is none.
    """
    root = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}-loads"
    at = f"{root.rstrip('/')}/load-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    there = spark.catalog.tableExists(name)
    if there and spark.table(name).dtypes != df.dtypes:
        spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
        there = False
    if there:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{at}'")
        spark.catalog.refreshTable(name)
    else:
        cols = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet LOCATION '{at}'")
    return spark.table(name).count()
