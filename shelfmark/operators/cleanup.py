"""Plans for removing duplicate files: which copy stays, which may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.duplicates import hex_of, number_groups

STRATEGIES = ("shortest", "oldest", "newest", "alphabetical")


def _copies(latest: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    files = latest.where(f"is_dir = 0 and full_hash is not null and size >= {min_size}")
    groups = number_groups(files.groupBy("drive_id", "full_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    device = F.coalesce("device", F.lit(-1))
    own = F.when(F.col("inode").isNull(), F.col("rel_path"))
    copies = (
        files.groupBy("drive_id", "full_hash", F.struct("inode", device.alias("d"), own.alias("own")).alias("copy"))
        .agg(F.min(F.struct("rel_path", "id", "size", "mtime")).alias("r"), F.count(F.lit(1)).alias("links"))
        .select("drive_id", "full_hash", F.col("r.rel_path").alias("rel_path"), F.col("r.id").alias("id"), F.col("r.size").alias("size"), F.col("r.mtime").alias("mtime"), (F.col("links") - 1).alias("hardlinks"))
    )
    return copies, groups


def cleanup_plan(latest: DataFrame, strategy: str = "shortest", min_size: int = 1 << 20) -> DataFrame:
    """One row per physical copy of each content with two or more: group, keep or remove.

    Hard links of a file are one copy, shown by its first path and a count. Groups
    are numbered by full hash within the drive, those skipped for having one
    physical copy included. 'oldest' and 'newest' take a time of 0 or null for
    unknown. Ties are decided by path.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    copies, groups = _copies(latest, min_size)
    known = F.when(F.col("mtime") != 0, F.col("mtime"))
    first = {
        "shortest": F.length("rel_path").cast("double"),
        "oldest": F.coalesce(known, F.lit(float("inf"))),
        "newest": -F.coalesce(known, F.lit(0.0)),
        "alphabetical": F.lit(0.0),
    }[strategy]
    # The copy to keep is the minimum of an aggregation, not the first row of a sorted group.
    keepers = copies.groupBy("drive_id", "full_hash").agg(F.min(F.struct(first.alias("by"), "rel_path", "id")).alias("k"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return (
        copies.join(keepers, ["drive_id", "full_hash"])
        .join(groups.select("drive_id", "full_hash", "group_id"), ["drive_id", "full_hash"])
        .select("drive_id", "group_id", hex_of("full_hash").alias("hash"), "id", "rel_path", "size", "mtime", "hardlinks", "n_copies", F.col("k.rel_path").alias("keeper"), (F.col("id") == F.col("k.id")).alias("keep"))
    )


def plan_groups(plan: DataFrame) -> DataFrame:
    """Per group: copies, copies to remove, and bytes that removing them frees."""
    gone = ~F.col("keep")
    return plan.groupBy("drive_id", "group_id", "hash", "keeper").agg(
        F.max("n_copies").alias("n_copies"), F.count_if(gone).alias("n_actions"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("freeable"), F.sum("hardlinks").alias("n_hardlinks")
    )
