"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes a DataFrame.  These helpers exist for scripts, tests and ``bench.py``.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

# Session settings the marts rely on.  Timestamps in the trip tables are
# wall-clock values without a zone (TIMESTAMP_NTZ), so the zone only matters
# for casts to/from TIMESTAMP; pin it anyway so results never depend on the
# host.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # PySpark 4 records the Python call site of every DataFrame/Column call
    # (error context), costing several py4j round trips per expression.
    # Plans here are built from hundreds of expressions, so batch sessions
    # made by this package switch it off; sessions made elsewhere are left
    # as they are.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Joins are planned from sizes Catalyst can prove; anything it cannot
    # bound goes through a shuffle join.  10 MB is Spark's default and is
    # kept explicit so the choice is visible.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def build_session(master: str | None = None, app: str = "taxilens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf.update(REQUIRED_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session made elsewhere, and
    make the package importable on the executors."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """``addPyFile`` a zip of this package, once per SparkContext.

    Pandas UDFs, ``applyInPandas`` and ``mapInPandas`` run functions of this
    package on the executors, which must be able to import it.  The zip is
    built in memory and written through the Hadoop file system API into the
    shared checkpoint folder, so the same code works for local paths and
    for cluster storage URLs.
    """
    sc = spark.sparkContext
    with _SHIP_LOCK:
        if sc.applicationId in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _, files in os.walk(pkg):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        data = buf.getvalue()
        path = scratch_path(spark, f"pyfiles/taxilens-{hashlib.sha1(data).hexdigest()[:12]}.zip")
        jvm = sc._jvm
        hp = jvm.org.apache.hadoop.fs.Path(path)
        fs = hp.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(hp):
            out = fs.create(hp, False)
            out.write(bytearray(data))
            out.close()
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, creating a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is.  A local temporary folder is only chosen when nothing is configured,
    which happens in tests and local runs.
    """
    d = checkpoint_dir(spark)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="taxilens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediates."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
