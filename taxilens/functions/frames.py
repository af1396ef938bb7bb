"""Small DataFrame building blocks used by several marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_global(df: DataFrame, **aggs: Column) -> DataFrame:
    """Add whole-table aggregates of ``df`` as columns of every row.

    Only for tables bounded by a dimension (one row per zone, tier, year
    ...), never for trip-level data: the aggregate is a window over the
    whole (small) table, so the table's own plan, and the trip scan below
    it, runs once.  A scalar subquery or a join would run that plan a
    second time, i.e. scan the trips twice.
    """
    w = Window.partitionBy(F.lit(0))
    return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])


def top_k(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """ORDER BY ... LIMIT n; Spark plans TakeOrderedAndProject (per-task top-n,
    then a merge of n rows per task), never a full sort."""
    return df.orderBy(*order).limit(n)


def one_row(df: DataFrame, *others: DataFrame) -> DataFrame:
    """Append the columns of one-row DataFrames (aggregates) to ``df``.

    Each one-row input becomes a struct-valued scalar subquery, evaluated
    once; no join (and no cross product) is planned.
    """
    out = df
    for i, o in enumerate(others):
        tag = f"__o{i}"
        out = out.withColumn(tag, o.select(F.struct(*o.columns).alias("v")).scalar())
        out = out.select(*[c for c in out.columns if c != tag], *[F.col(f"{tag}.{c}").alias(c) for c in o.columns])
    return out


def grouped_schema(df: DataFrame, group: Sequence[str], columns: str) -> str:
    """DDL of the group columns of ``df`` followed by ``columns``."""
    types = dict(df.dtypes)
    return ", ".join([*(f"`{g}` {types[g]}" for g in group), columns])
