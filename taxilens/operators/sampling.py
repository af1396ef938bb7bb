"""Exact-size reproducible uniform sample (L3).

The reference draws ``ORDER BY rand() LIMIT n``.  Here every row gets a
seeded hash value u in [0, 1); the sample is the n rows with the smallest u,
a uniform sample without replacement that is identical on every
recomputation.  It takes two scans and no sort of the table:

1. a histogram of u over ``BINS`` equal-width bins, per group (map-side
   combined); running sums over it give the bin where the count reaches n;
2. rows of lower bins are in the sample.  Only rows of the boundary bin,
   about one in ``BINS``, are ranked.  Exact copies of a row share u, so
   they are collapsed to (row, copies) first: a group of copies holding a
   third of the table is one ranked row, and the needed number of copies is
   re-emitted with ``array_repeat`` + ``explode``.

Everything is one lazy plan; nothing reaches the driver.  Ties in u are
ordered by all columns, so the sample is the same on every run and its size
is always exactly min(n, N).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

BINS = 1 << 20


def hash_unit(seed: int, keys: Sequence[str | Column]) -> Column:
    """Seeded uniform value in [0, 1) from the row key."""
    return X.hash_key(int(seed), *keys) / F.lit(float(1 << X.HASH_BITS))


def sample_exact(df: DataFrame, n: int, *, keys: Sequence[str | Column], seed: int = 42,
                 by: str | None = None, bins: int = BINS) -> DataFrame:
    """The ``n`` rows of ``df`` (of each value of ``by``) with the smallest
    seeded hash of ``keys``."""
    cols = df.columns
    group = F.lit(0) if by is None else F.col(by)
    u = df.withColumns({"__g": group, "__u": hash_unit(seed, keys)})
    u = u.withColumn("__bin", F.floor(F.col("__u") * F.lit(float(bins))))
    hist = u.groupBy("__g", "__bin").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("__g").orderBy("__bin"))
    # the last bin that is touched, and how many rows lie before it: one row per group
    cut = (hist.withColumn("below", upto - F.col("c")).where(F.col("below") < n)
           .groupBy(F.col("__g").alias("__cg")).agg(F.max(F.struct("__bin", "below")).alias("__cut")))
    u = u.join(cut, u["__g"].eqNullSafe(cut["__cg"]))
    inside = u.where(F.col("__bin") < F.col("__cut.__bin")).select(*cols)
    edge = (u.where(F.col("__bin") == F.col("__cut.__bin")).withColumn("__take", F.lit(n) - F.col("__cut.below"))
            .groupBy("__g", "__take", "__u", *cols).agg(F.count(F.lit(1)).alias("__copies")))
    w = Window.partitionBy("__g").orderBy("__u", *cols).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("__left", F.col("__take") - F.coalesce(F.sum("__copies").over(w), F.lit(0))).where("__left > 0")
    again = F.array_repeat(F.lit(1), F.least("__copies", "__left").cast("int"))
    return inside.unionByName(edge.withColumn("__k", F.explode(again)).select(*cols))
