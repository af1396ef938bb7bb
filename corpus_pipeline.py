"""Corpus pipeline: language ID, near duplicates, decontamination, mixing,
token store.

Every stage works on all rows that its predecessor kept and passes on the
columns of documents as they are.  Rows are told apart by their id and a
hash of their text, so null and repeated ids do no harm; columns that the
stages add on the way start with an underscore pair and end inside a stage.

In every stage null text is empty text, rows of an empty table give an empty
table, very long texts are read whole, and columns beyond id, text, lang and
source pass through whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxilens.llm import decontaminate, jaccard, language, mixing, token_store
from taxilens.llm.common import documents, small, written
from taxilens.session import scratch_path
from taxilens.session import prepare as prepare_session

#: Documents whose language is told with less confidence go.
MIN_SCORE = 0.5


#: Rows that go to a Python worker at once: so many, and no more once they
#: have so many bytes.  Stages run one after another in the same workers, so
#: each should hold little, however long the texts are.
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _same(docs: DataFrame, table: DataFrame) -> Column:
    return F.col("__id").eqNullSafe(docs["doc_id"].cast("long")) & (F.col("__version") == F.xxhash64(docs["text"]))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not those without a letter (null
    and empty texts among them), nor those the network scores under MIN_SCORE.
    Repeated rows stay or go together.  Without a labelled row nothing can be
    told, and none stays."""
    prepare(spark)
    cols = docs.columns
    out = language.identify(docs, language.train(docs), *cols, names=("__lang", "__score"))
    return out.where((F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= MIN_SCORE)).select(*cols)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: the one with the
    smallest id, null being larger than any, then the smallest hash of the text.
    Documents without words are linked with nothing and stay.  Of rows equal
    in id and text one stays, the smallest in its other columns, unless they
    have no words."""
    prepare(spark)
    groups = written(jaccard.jaccard_components(docs).select("doc_id", "version", "n_shingles", "component"), "pipeline-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    first = groups.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("first"))
    first = first.select(F.col("first.doc_id").alias("__id"), F.col("first.version").alias("__version"), F.lit(True).alias("__one"))
    empty = groups.where("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.lit(False).alias("__one")).distinct()
    stay = first.unionByName(empty)
    rows = groups.groupBy(F.col("doc_id").alias("g_id"), F.col("version").alias("g_version")).agg(F.count(F.lit(1)).alias("__rows"))
    stay = stay.join(rows, F.col("__id").eqNullSafe(F.col("g_id")) & (F.col("__version") == F.col("g_version"))).drop("g_id", "g_version")
    stay = small(written(stay, "pipeline-stay"), 32)
    kept = docs.join(stay, _same(docs, stay))
    single = kept.where(~F.col("__one") | (F.col("__rows") == 1)).select(*docs.columns)
    again = kept.where(F.col("__one") & (F.col("__rows") > 1)).groupBy("__id", "__version").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return single.unionByName(again.select("__row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the table ``benchmark`` was found.  Null
    texts and items match nothing; repeated rows stay or go together."""
    prepare(spark)
    found = decontaminate.with_hits(docs, documents(spark, sf_dir, "benchmark"), "__hits")
    return found.where(F.size("__hits") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it was taken.  A null source is one
    of its own; documents without words are never taken; of rows equal in id,
    text and source each is taken as often as the mix took one of them."""
    prepare(spark)
    plan = mixing.fair_mix(docs)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    plan = plan.select(F.col("doc_id").cast("long").alias("__id"), F.col("version").alias("__version"), F.col("source").alias("__source"), copies.alias("__copies")).where("__copies > 0").distinct()
    plan = small(written(plan, "pipeline-mix"), 48)
    taken = docs.join(plan, _same(docs, plan) & docs["source"].eqNullSafe(plan["__source"]))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the mix, as read back: in order of id, null first,
    then by text; each of repeated rows has a frame of its own, an empty text
    the end id alone."""
    prepare(spark)
    return token_store.token_store(docs).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: SQL has neither a convolutional network nor the tokenizer, so no statement
#: gives run()'s rows; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    at = scratch_path(spark, f"pipeline-{uuid.uuid4().hex[:12]}")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
