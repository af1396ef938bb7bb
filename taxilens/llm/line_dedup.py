"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches.  A batch's lines are aggregated to one row per
key and merge-anti-joined with every run: keys that no run holds become a
new run, the others go to the counts of keys met again.  So the keys of the
runs are disjoint.  Runs are Parquet tables bucketed and sorted by key, all
with the same buckets; the anti-joins read them without another shuffle.
When a level has ``fanout`` runs, they are merged into one of the next level,
bucket by bucket.  After the last batch, runs and counts give, for each key,
its documents and the largest id.

A key is 128 bits: two 64-bit hashes of the stripped, lower-cased line.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxilens.session import scratch_path

from .common import documents, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = "\x20\t\n\x0b\x0c\r"
KEY = ["k1", "k2"]
MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


class LineRuns:
    """Levelled runs of (k1, k2, docs, top) under the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.again: DataFrame | None = None  # keys met again, of later batches

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _save(self, rows: DataFrame, kind: str) -> DataFrame:
        name = f"line_{kind}_{uuid.uuid4().hex[:12]}"
        path = scratch_path(self.spark, f"llm/{name}")
        rows.write.format("parquet").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay, and the frame has its plan
        return table

    def add(self, batch: DataFrame) -> None:
        """``batch``: (k1, k2, docs, top), one row per key."""
        batch = self._save(batch.repartition(self.buckets, *KEY), "batch")
        fresh = reduce(lambda b, run: b.join(run.select(*KEY), KEY, "left_anti"), self.runs(), batch)
        if self.runs():
            fresh = self._save(fresh, "run")
            known = batch.join(fresh.select(*KEY), KEY, "left_anti")
            self.again = self._save(_merged(self.again, known) if self.again is not None else known, "again")
        self.levels[0].append(fresh)
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._save(reduce(_merged, level), "run"))

    def totals(self) -> DataFrame:
        """(k1, k2, docs, top) of every key added."""
        return reduce(_merged, self.runs() + ([self.again] if self.again is not None else []))


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one: a merge join of equal buckets, no shuffle."""
    b = b.select(*KEY, F.col("docs").alias("docs_b"), F.col("top").alias("top_b"))
    return a.join(b, KEY, "full_outer").select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("docs_b", F.lit(0))).alias("docs"), F.greatest("top", "top_b").alias("top"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): kept is the text without the lines
    whose key has ``min_chars`` code points and more, lies in ``min_docs``
    documents and more, and also in a document with a larger id.

    Null text is one empty line.  A null id is smaller than any other.
    Rows equal in id and text count as one document; all rows with the
    largest id keep their lines.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ident = [F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("version")]
    lines = docs.select(*ident, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.char_length("key") >= min_chars)
    lines = lines.select("id", "version", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(17), "key").alias("k2"))
    lines = lines.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(batches)).cast("int"))
    path = scratch_path(spark, f"llm/lines-{uuid.uuid4().hex[:12]}")
    schema = lines.schema
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(schema).parquet(path)

    runs = LineRuns(spark)
    for b in range(batches):
        one = lines.where(F.col("batch") == b).groupBy(*KEY, "id", "version").agg(F.lit(1).alias("n"))
        runs.add(one.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("top")))
    often = written(runs.totals().where(F.col("docs") >= min_docs).select(*KEY, "top"), "lines-often")

    drops = lines.select(*KEY, "id", "version", "pos").join(often, KEY).where(F.col("id") < F.col("top"))
    drops = drops.groupBy("id", "version").agg(F.collect_set("pos").alias("drop"))
    docs = docs.select("*", *ident).join(drops, ["id", "version"], "left")
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    split = F.split("text", "\n", -1)
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda _, i: ~F.array_contains(gone, i)), "\n"))
    return docs.select("doc_id", F.size(split).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line,
         translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) d, unnest(range(1, len(s) + 1)) u(i)),
often AS (
  SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, o.top IS NOT NULL AND l.doc_id < o.top AS gone FROM l LEFT JOIN often o ON o.key = l.key)
GROUP BY doc_id
"""
