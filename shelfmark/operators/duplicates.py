"""Duplicates inside a drive: candidates, confirmed groups, folders, and rows for export.

Groups are built by aggregation alone, so that a content held by very many rows
is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.columns import human_size, physical_copy
from shelfmark.operators.hot_keys import ordered_ranks

KEY = ("drive_id", "size", "partial_hash")


def hex_of(column: str):
    return F.lower(F.hex(column))


def candidate_groups(latest: DataFrame, min_size: int = 1024) -> DataFrame:
    """Keys (size, partial hash) held by more than one file of a drive."""
    files = latest.where(f"is_dir = 0 and error is null and size >= {min_size} and partial_hash is not null")
    return files.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("drive_id", "size", hex_of("partial_hash").alias("partial"), "n")


def fill_candidates(latest: DataFrame, min_size: int = 1024) -> DataFrame:
    """Files without a full hash whose key isn't theirs alone: those worth reading whole."""
    files = latest.where(f"is_dir = 0 and error is null and size >= {min_size} and partial_hash is not null")
    shared = files.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return files.where("full_hash is null").join(shared, list(KEY), "left_semi").select("drive_id", "id", "rel_path", "size")


def confirmed_groups(latest: DataFrame, min_size: int = 1024) -> DataFrame:
    """Contents (full hash) of more than one file of a drive, with physical copies and waste."""
    files = latest.where(f"is_dir = 0 and full_hash is not null and size >= {min_size}")
    per = files.groupBy("drive_id", "full_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.sum("size").alias("total"), F.countDistinct("inode", "device").alias("inodes")
    )
    distinct = F.when(F.col("inodes") > 0, F.col("inodes")).otherwise(F.col("n"))
    return (
        per.where("n > 1")
        .withColumn("distinct_copies", distinct)
        .select("drive_id", hex_of("full_hash").alias("hash"), "n", "size", "total", "distinct_copies", (F.col("n") - F.col("distinct_copies")).alias("hardlinks"),
                (F.col("size") * (F.col("distinct_copies") - 1)).alias("wasted"))
    )


def _physical(files: DataFrame, *keys: str) -> DataFrame:
    """One row per physical file of each key, with the hash of its first path."""
    copy = physical_copy(F.col("inode"), F.col("device"), F.col("id"))
    return (
        files.withColumn("copy", copy)
        .groupBy(*keys, "copy")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("rel_path", "id", "full_hash")).alias("first"))
        .select(*keys, "n_rows", F.col("first.rel_path").alias("rel_path"), F.col("first.id").alias("id"), F.col("first.full_hash").alias("full_hash"))
    )


def file_groups(latest: DataFrame, min_size: int = 1024) -> DataFrame:
    """Duplicate groups per key: confirmed by full hash where all copies have one, else approximate.

    Hard links count once. A key with any copy not fully hashed is one unconfirmed group.
    """
    files = latest.where(f"is_dir = 0 and partial_hash is not null and size >= {min_size}")
    whole = Window.partitionBy(*KEY)
    per_hash = (
        _physical(files, *KEY)
        .groupBy(*KEY, "full_hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.sum("n_rows").alias("n_rows"), F.min(F.struct(F.length("rel_path").alias("l"), "rel_path")).alias("short"))
        .withColumn("all_copies", F.sum("copies").over(whole))
        .withColumn("all_rows", F.sum("n_rows").over(whole))
        .withColumn("open", F.coalesce(F.sum(F.when(F.col("full_hash").isNull(), F.col("copies"))).over(whole), F.lit(0)))
        .withColumn("hardlinks", F.col("all_rows") - F.col("all_copies"))
    )
    confirmed = per_hash.where("open = 0 and copies > 1").select("drive_id", hex_of("full_hash").alias("hash"), F.lit(True).alias("confirmed"), "size", F.col("copies").alias("n"), "hardlinks")
    rest = per_hash.where("open > 0 and all_copies > 1").groupBy(*KEY).agg(F.max("all_copies").alias("n"), F.max("hardlinks").alias("hardlinks"))
    approximate = rest.select("drive_id", hex_of("partial_hash").alias("hash"), F.lit(False).alias("confirmed"), "size", "n", "hardlinks")
    return confirmed.unionByName(approximate).withColumn("wasted", F.col("size") * (F.col("n") - 1))


def unconfirmed_backlog(latest: DataFrame, min_size: int = 1024) -> DataFrame:
    """Per drive: groups that only lack full hashes, and the bytes they may waste."""
    files = latest.where(f"is_dir = 0 and size >= {min_size} and partial_hash is not null and full_hash is null")
    groups = files.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.groupBy("drive_id").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("size") * (F.col("n") - 1)).alias("bytes"))


def number_groups(groups: DataFrame) -> DataFrame:
    """Adds ``group_id``: the rank of a drive's group by full hash, from 1, without one task per drive."""
    return ordered_ranks(groups, ["drive_id"], ["full_hash"], "group_id")


def duplicate_rows(latest: DataFrame, min_size: int = 1024) -> DataFrame:
    """The rows of all confirmed groups, flat for export; repeated (inode, device) are hard links."""
    files = latest.where(f"is_dir = 0 and full_hash is not null and size >= {min_size}")
    groups = files.groupBy("drive_id", "full_hash").agg(F.count(F.lit(1)).alias("group_count"), F.countDistinct("inode", "device").alias("inodes")).where("group_count > 1")
    groups = number_groups(groups)
    # The first path of each (inode, device) is the file, the others are links to it.
    firsts = (
        files.where("inode is not null").groupBy("drive_id", "full_hash", "inode", F.coalesce("device", F.lit(-1)).alias("dev")).agg(F.min(F.struct("rel_path", "id")).alias("f"))
        .select("drive_id", F.col("f.id").alias("id"), F.lit(1).alias("is_first"))
    )
    distinct = F.when(F.col("inodes") > 0, F.col("inodes")).otherwise(F.col("group_count"))
    return (
        files.join(groups, ["drive_id", "full_hash"])
        .join(firsts, ["drive_id", "id"], "left")
        .withColumn("distinct_inodes", distinct)
        .withColumn("wasted_bytes", F.col("size") * (F.col("distinct_inodes") - 1))
        .select(
            "drive_id", "group_id", hex_of("full_hash").alias("hash"), F.col("size").alias("size_bytes"), human_size(F.col("size")).alias("size_human"), "group_count",
            "distinct_inodes", "wasted_bytes", human_size(F.col("wasted_bytes")).alias("wasted_human"), F.col("rel_path").alias("path"),
            (F.col("inode").isNotNull() & F.col("is_first").isNull()).alias("is_hardlink"),
        )
    )
