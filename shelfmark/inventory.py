"""The inventory as operators see it: current rows with their paths, per drive and snapshot."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.runtime import drop_materialized, scratch_dir
from shelfmark.sources.store import Store, is_store
from shelfmark.tables import current_rows, delivered_snapshots, read_table

COLUMNS = (
    "drive_id", "drive", "snapshot_id", "idx", "is_latest", "id", "parent_id", "path_id", "rel_path", "is_dir", "size", "mtime",
    "partial_hash", "full_hash", "is_symlink", "error", "inode", "device",
)

_ROW = ("snapshot_id", "path_id", "id", "parent_id", "is_dir", "size", "mtime", "partial_hash", "full_hash", "is_symlink", "error", "inode", "device")


def all_entries(entries: DataFrame, snapshots: DataFrame, paths: DataFrame, drives: DataFrame, latest_only: bool = False) -> DataFrame:
    """Current rows of all delivered snapshots (or each drive's latest) with ``rel_path`` and ``drive``.

    ``rel_path`` is the stored full_path; a row whose path text isn't stored keeps
    the name '#' and its path_id, so that no row is lost. ``drive`` is the drive's
    label, null where it has none.
    """
    delivered = delivered_snapshots(entries, snapshots).select("snapshot_id", "drive_id", "idx", "is_latest")
    rows = entries.drop("drive_id")
    if latest_only:
        delivered = delivered.where("is_latest")
        rows = rows.join(delivered.select("snapshot_id"), "snapshot_id", "left_semi")
    texts = paths.where("id is not null").select(F.col("id").alias("path_id"), "full_path")
    labels = drives.where("id is not null").groupBy(F.col("id").alias("drive_id")).agg(F.min("label").alias("drive"))
    return (
        current_rows(rows, *_ROW)
        .join(delivered.join(labels, "drive_id", "left"), "snapshot_id")
        .join(texts, "path_id", "left")
        .withColumn("rel_path", F.coalesce("full_path", F.concat(F.lit("#"), F.col("path_id").cast("string"))))
        .select(*COLUMNS)
    )


#: The setting that names a folder where prepared indexes stay from one application to the next.
INDEX_DIR = "spark.shelfmark.index.dir"
_TABLES = ("entries_core", "snapshots", "paths", "drive")
_prepared: dict[tuple, tuple[str, DataFrame]] = {}


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_inventory(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """Tables by name: of a folder with a Parquet table for each, or of a :class:`Store`.

    Labels are for people: an inventory without a table of drives is one all the same.
    """
    if is_store(spark, folder):
        tables = Store(spark, folder).tables()
        if unknown := set(names) - set(tables):
            raise ValueError(f"a store has no tables {sorted(unknown)}")
        return [tables[n] for n in names]
    unlabelled = "drive" in names and not _exists(spark, f"{folder}/drive.parquet")
    return [spark.createDataFrame([], "id long, label string") if n == "drive" and unlabelled else read_table(spark, folder, n) for n in names]


def _signature(folder: str, tables: list[DataFrame], latest_only: bool) -> str:
    """What the tables' files are: their names, and the length and times of change of what lies in ``folder``."""
    spark = tables[0].sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))
    files = sorted({f for t in tables for f in t.inputFiles()})
    return hashlib.sha256(repr((_LAYOUT, latest_only, fs.getContentSummary(path).getLength(), there, files)).encode()).hexdigest()[:32]


#: Raised when the index's columns or layout change, so that an older one isn't read.
_LAYOUT = 2


def load(spark: SparkSession, folder: str, latest_only: bool = True) -> DataFrame:
    """:func:`all_entries` of the tables in ``folder``, as a written index.

    This is the index that searches and reports read. It is made on first use and
    again when the tables have changed. It lies in the folder that the setting
    ``spark.shelfmark.index.dir`` names, where later applications find it again,
    else in the application's scratch folder. It is partitioned by drive; a drive
    with many rows has many files, one with few has one.
    """
    tables = read_inventory(spark, folder, *_TABLES)
    key, signature = (spark.sparkContext.applicationId, folder, latest_only), _signature(folder, tables, latest_only)
    if _prepared.get(key, ("",))[0] == signature:
        return _prepared[key][1]
    if key in _prepared and not spark.conf.get(INDEX_DIR, None):
        drop_materialized(_prepared[key][1])
    path = f"{spark.conf.get(INDEX_DIR, None) or scratch_dir(spark)}/inventory-{signature}"
    index = all_entries(*tables, latest_only=latest_only)
    if not _exists(spark, f"{path}/_SUCCESS"):
        index.hint("rebalance", "drive_id").write.mode("overwrite").partitionBy("drive_id").parquet(path)
    _prepared[key] = (signature, spark.read.schema(index.schema).parquet(path).select(*COLUMNS))
    return _prepared[key][1]
