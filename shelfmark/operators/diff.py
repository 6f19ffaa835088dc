"""Differences between two snapshots of a drive, and which snapshots to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.columns import top_folder
from shelfmark.functions.text import with_nfc
from shelfmark.runtime import materialize


def last_two(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each drive's files of the delivered snapshot before the latest, and of the latest."""
    ends = entries.groupBy("drive_id").agg(F.max("idx").alias("last_idx"))
    j = entries.where("is_dir = 0").join(ends, "drive_id")
    return j.where("idx = last_idx - 1").drop("last_idx"), j.where("idx = last_idx and last_idx > 1").drop("last_idx")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(drive_id, change, rel_path, old_size, new_size) of files between two snapshots.

    Files are matched by path first; size (null unequal to nothing) or partial hash
    (null-safe) make a modification. What is left as added and removed is matched
    again by composed path text, since the same name may be stored composed or not:
    both rows drop out, and count as modified where the size differs.
    """
    a = old.select("drive_id", "path_id", F.col("rel_path").alias("old_path"), F.col("size").alias("old_size"), F.col("partial_hash").alias("old_hash"), F.lit(1).alias("in_old"))
    b = new.select("drive_id", "path_id", F.col("rel_path").alias("new_path"), F.col("size").alias("new_size"), F.col("partial_hash").alias("new_hash"), F.lit(1).alias("in_new"))
    j = a.join(b, ["drive_id", "path_id"], "full")
    change = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "removed")
        .when(F.coalesce(F.col("old_size") != F.col("new_size"), F.lit(False)) | ~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    )
    rows = j.select("drive_id", change.alias("change"), F.coalesce("new_path", "old_path").alias("rel_path"), "path_id", "old_size", "new_size").where("change is not null")
    rows = materialize(rows, "changes")
    loose = materialize(with_nfc(rows.where("change <> 'modified'"), "rel_path", "form"), "loose")
    gone = (
        loose.where("change = 'removed'").groupBy("drive_id", "form").agg(F.max(F.struct("rel_path", "path_id", "old_size")).alias("g"))
        .select("drive_id", "form", F.col("g.old_size").alias("gone_size"), F.lit(1).alias("was"))
    )
    added = loose.where("change = 'added'").join(gone, ["drive_id", "form"], "left")
    again = added.where("was is not null")
    kept = added.where("was is null").select("drive_id", "change", "rel_path", "old_size", "new_size")
    resized = again.where("coalesce(gone_size, 0) <> coalesce(new_size, 0)").select("drive_id", F.lit("modified").alias("change"), "rel_path", F.col("gone_size").alias("old_size"), "new_size")
    removed = loose.where("change = 'removed'").join(again.select("drive_id", "form").distinct(), ["drive_id", "form"], "left_anti")
    out = ["drive_id", "change", "rel_path", "old_size", "new_size"]
    return rows.where("change = 'modified'").select(*out).unionByName(kept).unionByName(resized).unionByName(removed.select(*out))


def _delta():
    return F.coalesce("new_size", F.lit(0)) - F.coalesce("old_size", F.lit(0))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Per drive: counts and bytes added and removed, count and growth of modified files."""

    def of(kind: str, value):
        return F.coalesce(F.sum(F.when(F.col("change") == kind, value)), F.lit(0)).cast("long")

    one = F.lit(1)
    return diff.groupBy("drive_id").agg(
        of("added", one).alias("added_count"), of("added", _delta()).alias("added_bytes"), of("removed", one).alias("removed_count"), of("removed", -_delta()).alias("removed_bytes"),
        of("modified", one).alias("modified_count"), of("modified", _delta()).alias("modified_delta_bytes"),
    )


def folder_changes(diff: DataFrame) -> DataFrame:
    """Growth in bytes and files of each top folder (two levels) of a drive."""
    sign = F.when(F.col("change") == "added", 1).when(F.col("change") == "removed", -1).otherwise(0)
    return diff.groupBy("drive_id", top_folder(F.col("rel_path")).alias("folder")).agg(F.sum(_delta()).alias("growth"), F.sum(sign).cast("long").alias("files"))


def top_changes(diff: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Per drive the ``n`` folders of most 'growth', most 'shrink' or highest file 'count'; ties by name."""
    order = {"growth": F.desc("growth"), "shrink": F.asc("growth"), "count": F.desc("files")}[by]
    w = Window.partitionBy("drive_id").orderBy(order, "folder")
    # The rank filter is pushed below the shuffle, so a drive sends n rows per task.
    return folder_changes(diff).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def snapshot_retention(snapshots: DataFrame, as_of: str, keep_last: int = 10, keep_monthly: int = 12) -> DataFrame:
    """(drive_id, snapshot_id, keep): the newest ``keep_last``, then the newest of each month.

    Months count back ``31 * keep_monthly`` days from ``as_of``. A snapshot whose
    time can't be read is kept. Newest is by taken_at, then id.
    """
    at = F.try_to_timestamp("taken_at", F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    newest = Window.partitionBy("drive_id").orderBy(F.desc("taken_at"), F.desc("id"))
    s = snapshots.withColumn("at", at).withColumn("rank", F.row_number().over(newest))
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {31 * keep_monthly} days")
    old = (F.col("rank") > keep_last) & F.col("at").isNotNull() & (F.col("at") >= since)
    month = Window.partitionBy("drive_id", old, F.date_trunc("month", "at")).orderBy(F.desc("taken_at"), F.desc("id"))
    first = F.row_number().over(month) == 1
    keep = (F.col("rank") <= keep_last) | F.col("at").isNull() | (old & first)
    return s.select("drive_id", F.col("id").alias("snapshot_id"), F.coalesce(keep, F.lit(False)).alias("keep"))
