"""Folders written side by side: no sort of a task's rows, the same rows in the same folders."""
import glob
import os

import pytest
from conftest import SF_SMALL
from pyspark.sql import DataFrameWriter, functions as F
from taxilens.plans import registry as Q
from taxilens.sources import fixtures, materialize

ROWS = 200_000
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def table(spark, folders):
    return spark.range(0, ROWS, 1, 2).select("id", (F.col("id") % folders).cast("int").alias("year"), F.repeat(F.lit("x"), 100).alias("text"))


@pytest.mark.parametrize("folders", [7, materialize.OPEN_FOLDERS + 5])
def test_all_rows_in_their_folders(spark, tmp_root, folders):
    at = os.path.join(tmp_root, f"folders-{folders}")
    materialize.write_partitioned(table(spark, folders), at, ["year"], max_records_per_file=20_000)
    got = spark.read.parquet(at)
    assert (got.count(), got.distinct().count(), got.where(F.col("id") % folders != F.col("year")).count()) == (ROWS, ROWS, 0)
    assert len(glob.glob(f"{at}/year=*")) == folders
    assert spark.conf.get(WRITERS) == "0"  # only while it writes


def test_a_null_folder_and_no_rows(spark, tmp_root):
    at = os.path.join(tmp_root, "null-folder")
    rows = spark.createDataFrame([(1, 2024), (2, None)], "id long, year int")
    materialize.write_partitioned(rows, at, ["year"])
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [(1, 2024), (2, None)]
    materialize.write_partitioned(rows.where("id > 2"), at, ["year"], mode="append")
    assert spark.read.parquet(at).count() == 2


def test_writers_side_by_side_need_no_sort(spark):
    """What the setting is for: without it Spark sorts what goes to folders."""
    spark.sql("CREATE TABLE folders (id long, text string, year int) USING parquet PARTITIONED BY (year)")
    table(spark, 3).createOrReplaceTempView("folders_rows")
    plans = []
    for n in (materialize.OPEN_FOLDERS, 0):
        spark.conf.set(WRITERS, n)
        plans.append(spark.sql("EXPLAIN INSERT INTO folders SELECT id, text, year FROM folders_rows").first()[0])
    assert "Sort" not in plans[0] and "Sort" in plans[1]
    spark.sql("DROP TABLE folders")


@pytest.fixture
def unsorted(monkeypatch):
    """Every write of folders so far: could its tasks keep files side by side?"""
    seen, plain = [], DataFrameWriter.parquet

    def parquet(self, path, mode=None, partitionBy=None, compression=None):
        seen.append((path, int(self._spark.conf.get(WRITERS))))
        return plain(self, path, mode, partitionBy, compression)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return lambda part: [n >= 8 for path, n in seen if part in path]


def test_landing_once_does_not_sort(spark, unsorted):
    rows = fixtures.yellow_from_lineitem(fixtures.read_lineitem(spark, SF_SMALL))
    got = materialize.once(spark, "no-sort/yellow", lambda: rows, spark.read.parquet, partition_by=("year",))
    assert unsorted("/no-sort/") == [True]
    assert got.count() == rows.count()


def test_landing_by_batches_and_refresh_do_not_sort(spark, unsorted):
    Q._PLANS.clear()  # another test of this session may have landed it
    Q.refreshed_cells(spark, SF_SMALL)
    raw, cells = unsorted("/raw/batch="), unsorted("/cells/trips/") + unsorted("/cells/fares/") + unsorted("/cells/waits/")
    assert raw == [True] * 6 and cells == [True] * 9
