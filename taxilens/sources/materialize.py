"""Write a derived table once per application into the shared folder and reuse it.

Used for tables that are derived from the inputs and read by many queries
(the landed trip feeds, the rollup base).  Every table is written to a path
of its own, with Spark's job commit; its name is remembered by this driver
only after the write has succeeded.  So there is no rename to rely on, no
reader sees a partial table, and no other code or run can leave a stale one.
The table lives in ``spark.checkpoint.dir`` (shared storage on a cluster),
survives lost executors and cuts the lineage of every reader.  Nothing is
ever deleted.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .. import session as S

_LOCK = threading.RLock()   # re-entrant: building one table may materialize its inputs
_WRITTEN: dict[tuple[str, str], str] = {}

#: Folders that a task writes side by side; rows of further ones are sorted first.
OPEN_FOLDERS = 16
#: Bytes that each of these open files holds back at most (Parquet's row group).
ROW_GROUP_BYTES = 32 << 20
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], *, mode: str = "errorifexists",
                      max_records_per_file: int | None = None, **options: str) -> None:
    """Write ``df`` as Parquet with a folder per value of ``by``, a few years
    or batches.  A task keeps a file of each folder open; Spark's default is
    to sort all rows of the task by folder first, which holds or spills them
    all.  So memory is ``OPEN_FOLDERS`` row groups at most, whatever a split
    of the input unpacks to."""
    conf = df.sparkSession.conf
    before = conf.get(_WRITERS)
    w = df.write.mode(mode).partitionBy(*by).option("parquet.block.size", ROW_GROUP_BYTES).options(**options)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    conf.set(_WRITERS, OPEN_FOLDERS)
    try:
        w.parquet(path)
    finally:
        conf.set(_WRITERS, before)


def once(spark: SparkSession, relpath: str, build: Callable[[], DataFrame],
         read: Callable[[str], DataFrame], *, partition_by: Sequence[str] = (),
         max_records_per_file: int | None = None) -> DataFrame:
    """Return ``read(path)`` of the table called ``relpath``, building it first if absent."""
    key = (spark.sparkContext.applicationId, relpath)
    with _LOCK:
        if key not in _WRITTEN:
            target = f"{S.scratch_path(spark, relpath)}-{uuid.uuid4().hex[:12]}"
            if partition_by:
                write_partitioned(build(), target, partition_by, max_records_per_file=max_records_per_file)
            else:
                w = build().write.mode("errorifexists")
                if max_records_per_file:
                    w = w.option("maxRecordsPerFile", max_records_per_file)
                w.parquet(target)
            _WRITTEN[key] = target
        return read(_WRITTEN[key])
