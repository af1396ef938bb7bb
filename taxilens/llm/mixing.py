"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, gone through as
often as ``max_repeats`` allows.  A copy of a document gets a virtual finish
time, the words of its source queued up to its end divided by the source's
target, so all sources run at speeds in proportion to their targets.  The
mix is the prefix of the global order of finish times that fits the budget.

Only DataFrame functions.  Both running sums, the one inside a source and the
one over the whole queue, are two-level: a window inside a bucket of about
the square root of the rows, and offsets from a window over the bucket sums,
so no task holds a source or the queue, however hot the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, word_count, written

#: Weights by rank of the source (code point order, null last), repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2
SEED = "mix-1"


def shuffle_key(id_col: str, seed: str) -> Column:
    """52 bits of md5 of seed and id: a shuffle that reruns and other engines repeat."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n_rows, target): the budget shared by weight,
    each target at most ``max_repeats`` times the source's size.

    Resharing the excess until no target is above its cap ends in one place:
    the water level L with sum(min(weight * L, cap)) = budget.  With sources
    ordered by cap / weight, L follows from running sums.  The windows go
    over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = (per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
           .withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
           .withColumn("ratio", F.col("cap") / F.col("weight")))
    order = Window.orderBy("ratio", "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = (per.withColumn("b", F.sum("source_size").over(whole) * F.lit(budget))
           .withColumn("level", (F.col("b") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)))
    # the first source, in order of ratio, that the level leaves uncapped sets it
    per = per.withColumn("water", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank"))).over(whole))
    return per.select("source", F.col("source_size"), "n_rows",
                      F.least(F.col("weight") * F.coalesce("water", F.lit(0.0)), F.col("cap")).alias("target"))


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, version) for every
    row of ``docs``; version is a hash of the text, by which rows with one id
    can be told apart.

    Null text has size 0; a null source is a source of its own, ranked last;
    a null id is shuffled as the text "null".  Repeated rows each count and
    are each decided alike.  Empty documents take 0.  An empty table gives no
    rows.  Columns beyond the three named ones are not read.
    """
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("version")), "mix-sizes")
    per = written(targets(rows, weights, budget, max_repeats), "mix-targets")
    queue = (rows.join(per, rows["source"].eqNullSafe(per["source"])).drop(per["source"])
             .withColumn("key", shuffle_key("doc_id", seed))
             .withColumn("bucket", F.floor(F.col("key") / F.lit(float(1 << 52)) * F.ceil(F.sqrt("n_rows")))))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = queue.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size")
    sums = sums.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "offset")
    queue = queue.withColumn("run", F.sum("size").over(inside))
    queue = queue.join(sums, queue["source"].eqNullSafe(sums["s_source"]) & (queue["bucket"] == sums["s_bucket"]))
    queue = queue.withColumn("end", F.col("run") + F.col("offset"))
    queue = written(queue.select("doc_id", "size", "source_size", "target", "end", "key", "version", "source"), "mix-queue")

    finish = (F.col("end") + F.col("epoch") * F.col("source_size")) / F.col("target")
    copies = (queue.where((F.col("size") > 0) & (F.col("target") > 0))
              .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("finish", finish))
    # the few one-row figures come as scalar subqueries
    total = rows.agg(F.sum("size") * F.lit(budget)).scalar()
    rows_of = copies.agg(F.sqrt(F.count(F.lit(1)))).scalar()
    top = copies.agg(F.max("finish")).scalar()
    slot = F.floor(F.col("finish") / top * F.ceil(rows_of))
    copies = copies.withColumn("slot", slot)
    slots = copies.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    order = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = slots.withColumn("base", F.sum("slot_size").over(order) - F.col("slot_size"))
    crossing = slots.where((F.col("base") + F.col("slot_size") > total) & (F.col("base") <= total)).select("slot", "base")
    place = F.struct("finish", "epoch", "key", "doc_id", "size")
    edge = copies.join(crossing, "slot").withColumn("place", place)  # one slot
    edge = edge.withColumn("upto", F.col("base") + F.sum("size").over(Window.partitionBy("slot").orderBy("place")))
    # the first copy that does not fit; null if all do
    cut = written(edge.where(F.col("upto") > total).agg(F.min("place").alias("cut")), "mix-cut").select("cut").scalar()

    out = queue.withColumn("cut", cut)
    taken = F.lit(0)
    for e in range(max_repeats):
        at = F.struct(((F.col("end") + F.lit(e) * F.col("source_size")) / F.col("target")).alias("finish"), F.lit(e).alias("epoch"), "key", "doc_id", "size")
        taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & (F.col("cut").isNull() | (at < F.col("cut"))), F.col("size")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "version")


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(documents(spark, sf_dir)).drop("source", "version")


OP5_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::DOUBLE AS total,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 2 * total / w AS ratio,
         ((SELECT 1.5 * sum(total) FROM src) - coalesce(sum(2 * total) OVER (ORDER BY 2 * total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2 * total / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
tgt AS (
  SELECT source, total, least(w * (SELECT level FROM lev WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), 2 * total) AS target FROM lev),
q AS (
  SELECT s.*, t.total, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size) AS upto
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, (upto + e * total) / target AS finish FROM q, (VALUES (0), (1)) v(e) WHERE size > 0),
r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, e, k, doc_id, size) AS queued FROM c)
SELECT q.doc_id, q.size::BIGINT AS size, q.total::BIGINT AS source_size, q.target,
       coalesce((SELECT sum(r.size) FROM r WHERE r.doc_id = q.doc_id AND r.queued <= (SELECT 1.5 * sum(total) FROM tgt)), 0)::BIGINT AS taken
FROM q
"""
