"""Access to the inventory tables and the row sets that most operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.runtime import materialize


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder that holds one Parquet table per name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_seconds(text: Column) -> Column:
    """Unix seconds of a ``%Y-%m-%dT%H:%M:%S`` text read as UTC; null if it isn't one."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("double")


def current_rows(entries: DataFrame, *columns: str) -> DataFrame:
    """One row per (snapshot_id, path_id): of several deliveries, the last one loaded.

    The latest ``loaded_at`` wins, then the highest ``id``; a null ``loaded_at``
    counts as the earliest. Rows without a snapshot_id or path_id identify
    nothing and are left out. Deliveries are reduced before the shuffle, so a
    path that was delivered again and again doesn't fill one task.
    """
    rest = [F.col(c) for c in columns if c not in ("snapshot_id", "path_id", "loaded_at", "id")]
    return (
        entries.where("snapshot_id is not null and path_id is not null")
        .groupBy("snapshot_id", "path_id")
        .agg(F.max(F.struct("loaded_at", "id", *rest)).alias("r"))
        .select("snapshot_id", "path_id", *[F.col(f"r.{c}").alias(c) for c in columns if c not in ("snapshot_id", "path_id")])
    )


def delivered_snapshots(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots that have rows, numbered per drive by ``taken_at`` (ties by id).

    Columns: snapshot_id, drive_id, label, taken_s, idx (from 1), next_id (the
    drive's next delivered snapshot or null), is_latest. Snapshots without a
    drive, or rows of snapshots that aren't listed, can't be ordered and are left
    out. The result has one row per snapshot and is written, so that Catalyst
    broadcasts it only while it is known to be small.
    """
    order = Window.partitionBy("drive_id").orderBy(F.col("taken_s").asc_nulls_first(), "snapshot_id")
    listed = (
        snapshots.where("id is not null and drive_id is not null")
        .groupBy(F.col("id").alias("snapshot_id"))
        .agg(F.max(F.struct("taken_at", "drive_id", "label")).alias("s"))
        .select("snapshot_id", "s.drive_id", "s.label", epoch_seconds(F.col("s.taken_at")).alias("taken_s"))
    )
    present = entries.select("snapshot_id").distinct()
    return materialize(
        listed.join(present, "snapshot_id", "left_semi")
        .withColumn("idx", F.row_number().over(order))
        .withColumn("next_id", F.lead("snapshot_id").over(order))
        .withColumn("is_latest", F.col("next_id").isNull()),
        "delivered",
    )


def latest_file_rows(entries: DataFrame, snapshots: DataFrame, *columns: str) -> DataFrame:
    """File rows (current rows with is_dir = 0) of every drive's latest snapshot.

    Adds the snapshot's ``taken_s`` and its ``drive_id``.
    """
    latest = delivered_snapshots(entries, snapshots).where("is_latest").select("snapshot_id", "drive_id", "taken_s")
    kept = [c for c in dict.fromkeys(("is_dir", *columns)) if c != "drive_id"]
    rows = entries.drop("drive_id").join(latest.select("snapshot_id"), "snapshot_id", "left_semi")
    return current_rows(rows, "snapshot_id", "path_id", *kept).where("is_dir = 0").join(latest, "snapshot_id")
