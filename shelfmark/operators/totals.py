"""Totals, listings and breakdowns of drives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.columns import first_dot_extension, human_size


def drive_totals(latest: DataFrame) -> DataFrame:
    """Files (no links, no failed reads), folders and bytes per drive."""
    file = F.expr("is_dir = 0 and coalesce(is_symlink, 0) = 0 and error is null")
    return latest.groupBy("drive_id", "snapshot_id").agg(
        F.count_if(file).alias("total_files"), F.count_if(F.col("is_dir") == 1).alias("total_dirs"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("total_size")
    )


def drive_info(drives: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each listed drive with its recorded totals, the number of its snapshots and the latest one's time and label.

    The latest is by taken_at, then id. A drive without snapshots has 0 of them and nulls.
    """
    per = snapshots.groupBy("drive_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("taken_at", "id", "label")).alias("last"))
    return drives.join(per, F.col("id") == F.col("drive_id"), "left").select(
        F.col("id").alias("drive_id"), drives["label"], "root_path", "indexed_at", "hash_version", "total_files", "total_dirs", "total_size",
        F.coalesce("n", F.lit(0)).alias("n_snapshots"), F.col("last.taken_at").alias("last_taken_at"), F.col("last.label").alias("last_label"),
    )


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    """Snapshots, newest id first."""
    return snapshots.select("drive_id", F.col("id").alias("snapshot_id"), "taken_at", "label").orderBy(F.desc("snapshot_id"))


def extension_breakdown(latest: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` extensions with most bytes: files of any kind, bytes and a readable size."""
    files = latest.where("is_dir = 0").withColumn("ext", first_dot_extension(F.col("rel_path")))
    per = files.groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"))
    return per.orderBy(F.desc("size_bytes"), "ext").limit(limit).withColumn("size_human", human_size(F.col("size_bytes")))


def sizes_for_people(latest: DataFrame) -> DataFrame:
    """Every file's size in readable form."""
    return latest.where("is_dir = 0").select("id", human_size(F.col("size")).alias("size_human"))
