"""Type-drift audit and repair of raw Parquet files.

``passenger_count`` is a double in some files and a bigint in others.  Spark
cannot read such files in one pass (``mergeSchema`` fails on double/bigint, a
declared bigint schema fails on double files), so files are grouped by their
own types, each group is read with those, ``try_cast`` to the declared type
(NaN or out-of-range values become NULL, never an error under ANSI mode) and
united by name.

The file list is a DataFrame and footers are opened in tasks
(:func:`footers`): a row per file comes back, and audit, grouping and counts
are Spark aggregates over those rows.  To the driver come the distinct types
with the folders that hold files of only these; single files of a folder only
where their types differ.  The repaired table is written to a *new* location;
the table being read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegerType, LongType, ShortType, StructField, StructType, TimestampType

from ..schemas import FEEDS, PARTITION_COLUMN
from .materialize import write_partitioned

FOOTER_SCHEMA = "path string, schema string, columns map<string, string>, rows long, error string"
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def files(spark: SparkSession, where: str | Sequence[str], years: Iterable[int] | None = None) -> DataFrame:
    """(path, content) of the Parquet files under a folder, of all partitions
    or of ``years``, or of a list of files.  Unless selected, content is not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    found = reader.option("recursiveFileLookup", "true").load(where) if isinstance(where, str) else reader.load(list(where))
    if years is not None:
        found = found.where(F.regexp_extract("path", f"/{PARTITION_COLUMN}=([0-9]+)/", 1).isin([str(y) for y in years]))
    return found.select("path", "content")


def _file_system(path: str):
    """File system and path for pyarrow, or an error if it knows none."""
    from pyarrow import fs
    if path.startswith("file:") or path.startswith("/"):
        local = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + local.lstrip("/")
    return fs.FileSystem.from_uri(path)


def _opens(path: str) -> bool:
    try:
        system, at = _file_system(path)
        return system.get_file_info(at).is_file
    except Exception:  # noqa: BLE001  a store that only Spark reads
        return False


def per_file(found: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(pyarrow.parquet.ParquetFile) -> dict`` for each file of
    :func:`files`, in tasks; rows have the path and, where it failed, the
    error.  Such a row is no result: who needs all files raises it, others
    report it.  A task opens files itself, by ranges; from a store that only
    Spark reads, it gets them from Spark, whole."""
    first = found.select("path").first()
    by_range = first is None or _opens(first.path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(target)
        for b in batches:
            rows = []
            for i, path in enumerate(b.column(0).to_pylist()):
                try:
                    if by_range:
                        system, at = _file_system(path)
                        with system.open_input_file(at) as source:
                            row = fn(pq.ParquetFile(source))
                    else:
                        row = fn(pq.ParquetFile(pa.BufferReader(b.column(1)[i].as_buffer())))
                    rows.append({"path": path, "error": None, **row})
                except Exception as e:  # noqa: BLE001  a bad file is reported, others continue
                    rows.append({"path": path, "error": f"{type(e).__name__}: {str(e)[:300]}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    target = StructType.fromDDL(schema)
    return (found.select("path") if by_range else found).mapInArrow(run, schema)


def _spark_type(t: pa.DataType) -> DataType:
    """The type Spark reads a column of this Arrow type as."""
    from pyspark.sql.pandas.types import from_arrow_type
    if pa.types.is_unsigned_integer(t):
        return {8: ShortType(), 16: IntegerType(), 32: LongType(), 64: DecimalType(20, 0)}[t.bit_width]
    if pa.types.is_timestamp(t) and t.unit == "ns":  # INT96
        return TimestampType()
    if pa.types.is_dictionary(t):
        return _spark_type(t.value_type)
    return from_arrow_type(t, prefer_timestamp_ntz=True)


def _footer(file) -> dict:
    meta = file.metadata
    written = (meta.metadata or {}).get(_SPARK_SCHEMA)
    if written:
        import json
        schema = StructType.fromJson(json.loads(written))
    else:
        schema = StructType([StructField(f.name, _spark_type(f.type)) for f in file.schema_arrow])
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    return {"schema": schema.json(), "columns": [(f.name, f.dataType.simpleString()) for f in schema], "rows": meta.num_rows}


def footers(found: DataFrame) -> DataFrame:
    """One row per file of :func:`files`: its own schema (JSON), its columns'
    types, its row count, or the error its footer gives."""
    return per_file(found, _footer, FOOTER_SCHEMA)


def audit(spark: SparkSession, base: str, *, column: str = "passenger_count", target: str = "bigint",
          years: Iterable[int] | None = None) -> DataFrame:
    """One row per file: its partition, found type and the action the repair takes."""
    found = F.element_at("columns", F.lit(column))
    action = (F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.regexp_extract("error", "^[^:]*", 0)))
              .when(found.isNull(), F.lit("skipped: no column"))
              .when(found == target, F.lit("skipped: already " + target)).otherwise(F.lit("fixed")))
    year = F.regexp_extract("path", f"/{PARTITION_COLUMN}=([0-9]+)/", 1)
    return footers(files(spark, base, years)).select(
        F.when(year != "", year.cast("int")).alias("year"), "path", found.alias("found_type"), action.alias("action"))


def conform(df: DataFrame, target: StructType) -> DataFrame:
    """``df`` with the declared columns and types, missing columns as NULL."""
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    cols = []
    for f in target.fields:
        have = types.get(f.name.lower())
        if have is None:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            cols.append((F.col(f.name) if have == f.dataType else F.col(f.name).try_cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def readable_groups(foots: DataFrame, *, folders: bool = True) -> list[tuple[StructType, list[str]]]:
    """What can be read in one pass: each schema with the folders that hold
    files of it alone, and the single files of other folders; or, where
    ``foots`` are not all files of their folders, with single files only."""
    import json
    if not folders:
        foots = foots.withColumn("path", F.concat("path", F.lit("/")))  # each in a folder of its own
    foots = foots.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    kinds = foots.groupBy("folder", "schema").agg(F.count(F.lit(1)).alias("n"))
    pure = kinds.groupBy("folder").agg(F.count(F.lit(1)).alias("kinds"), F.min("schema").alias("schema"))
    mixed = foots.join(pure.where("kinds > 1").select("folder"), "folder", "left_semi").select("schema", F.col("path").alias("place"))
    groups: dict[str, list[str]] = {}
    for r in pure.where("kinds = 1").select("schema", F.col("folder").alias("place")).unionByName(mixed).collect():
        groups.setdefault(r.schema, []).append(r.place)
    return [(StructType.fromJson(json.loads(s)), sorted(places)) for s, places in sorted(groups.items())]


def read_groups(spark: SparkSession, groups: list[tuple[StructType, list[str]]], target: StructType, *, base: str | None = None) -> DataFrame:
    """The groups as one frame of the declared schema, whatever their own types."""
    def read(schema: StructType, places: list[str]) -> DataFrame:
        if base and PARTITION_COLUMN not in schema.fieldNames():  # it comes from the folder
            schema = StructType([*schema.fields, target[PARTITION_COLUMN]])
        reader = spark.read.schema(schema)
        return conform((reader.option("basePath", base) if base else reader).parquet(*places), target)

    return reduce(DataFrame.unionByName, [read(*g) for g in groups]) if groups else spark.createDataFrame([], target)


def normalize_types(spark: SparkSession, base: str, feed: str = "yellow", *,
                    years: Iterable[int] | None = None) -> DataFrame:
    """Read every file of a partitioned table with its own types and cast
    to the declared schema.  An unreadable footer is an error."""
    foots = footers(files(spark, base, years)).persist()
    try:
        bad = foots.where("error IS NOT NULL").first()
        if bad:
            raise ValueError(f"{bad.path}: {bad.error}")
        return read_groups(spark, readable_groups(foots), FEEDS[feed]["schema"], base=base)
    finally:
        foots.unpersist()


def rewrite(df: DataFrame, out: str, *, mode: str = "overwrite",
            max_records_per_file: int = 5_000_000) -> None:
    """Write a normalized raw table (snappy Parquet, partitioned by year).

    No shuffle: every task writes its own rows into the year folders they
    belong to; ``maxRecordsPerFile`` bounds file size.  (Repartitioning by
    ``year`` would funnel a whole year through one task.)
    """
    write_partitioned(df, out, [PARTITION_COLUMN], mode=mode, max_records_per_file=max_records_per_file, compression="snappy")
