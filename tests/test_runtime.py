import os
from urllib.parse import urlparse

from shelfmark.runtime import drop_materialized, materialize, scratch_dir, spread_scan


def local(path):
    return urlparse(path).path


def test_materialized_tables_keep_rows_and_schema_and_can_go(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (1, None, ["a"]), (None, "x", None)], "n long, t string, l array<string>")
    table = materialize(df, "test")
    assert table.schema == df.schema and sorted(map(str, table.collect())) == sorted(map(str, df.collect()))
    folder = os.path.dirname(local(table.inputFiles()[0]))
    assert folder.startswith(local(scratch_dir(spark)))
    drop_materialized(table)
    assert not os.path.exists(folder)


def test_other_tables_are_never_removed(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    drop_materialized(spark.read.parquet(str(tmp_path / "mine")))
    assert spark.read.parquet(str(tmp_path / "mine")).count() == 3


def test_a_small_scan_is_dealt_out_and_keeps_its_rows(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    spread = spread_scan(spark.read.parquet(str(tmp_path / "t")))
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and spread.distinct().count() == 100
