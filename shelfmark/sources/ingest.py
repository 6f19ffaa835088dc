"""Taking snapshots of folder trees: walk, take over known hashes, hash the rest, store."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.hashing import full_file_digest, partial_file_digest
from shelfmark.functions.columns import ancestors, base_name
from shelfmark.operators.duplicates import fill_candidates
from shelfmark.operators.folders import folder_hashes
from shelfmark.operators.upkeep import reuse_hashes, verify
from shelfmark.runtime import map_arrow, materialize
from shelfmark.sources import filesystem
from shelfmark.sources.store import Store


def _hash_files(root: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [os.path.join(root, p) for p in batch["rel_path"].to_pylist()]
            partial = [known or partial_file_digest(p, n) for p, n, known in zip(paths, batch["size"].to_pylist(), batch["partial_hash"].to_pylist())]
            whole = [known or (full_file_digest(p) if full else None) for p, known in zip(paths, batch["full_hash"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["rel_path"], pa.array(partial, pa.binary()), pa.array(whole, pa.binary())], names=["rel_path", "partial_hash", "full_hash"])

    return run


def walk(spark: SparkSession, root: str, exclusions: Sequence[str] = (), skip_cloud: bool = False, one_fs: bool = False) -> DataFrame:
    """The tree below ``root`` without hashes."""
    filesystem.register(spark)
    options = {"partial": "false", "exclusions": json.dumps(list(exclusions)), "skip_cloud": str(skip_cloud), "one_fs": str(one_fs)}
    return without_repeats(spark.read.format("foldertree").options(**options).load(root))


def without_repeats(rows: DataFrame) -> DataFrame:
    """A walked tree without what lies below a folder that was met before under another path.

    The same folder may be mounted at several places; of its paths the lowest keeps
    what is below it, and the others are listed as folders only.
    """
    rows = materialize(rows, "walked")
    folders = rows.where("is_dir = 1 and is_symlink = 0 and inode is not null")
    same = folders.groupBy("inode", "device").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("first")).where("n > 1")
    again = materialize(folders.join(same, ["inode", "device"]).where("rel_path <> first").select(F.col("rel_path").alias("above")), "met-again")
    if again.isEmpty():
        return rows
    below = rows.select("rel_path", F.explode(ancestors(F.col("rel_path"))).alias("above")).join(again, "above").select("rel_path").distinct()
    return rows.join(below, "rel_path", "left_anti")


def index(spark: SparkSession, store: Store, root: str, drive_id: int, taken_at: str, label: str | None = None, mode: str = "snapshot", full: bool = False, **options) -> int:
    """Store the tree below ``root`` as a snapshot and give its id.

    Files whose path, size and time are those of the latest snapshot take over its
    hashes; only the others are read, on the executors.
    """
    found = materialize(walk(spark, root, **options).withColumn("drive_id", F.lit(drive_id).cast("long")).withColumn("id", F.monotonically_increasing_id()), "walk")
    last = store.latest_id(drive_id) if mode != "fresh" else None
    if last is None:
        known = found.where("false").select("id", "partial_hash", "full_hash")
    else:
        old = store.latest(drive_id).withColumn("id", F.lit(0).cast("long"))
        known = reuse_hashes(old, found).select("id", "partial_hash", "full_hash")
    files = found.where("is_dir = 0 and is_symlink = 0 and error is null")
    to_read = files.drop("partial_hash", "full_hash").join(known, "id", "left").select("rel_path", "size", "partial_hash", "full_hash")
    hashed = map_arrow(to_read, _hash_files(root, full), "rel_path string, partial_hash binary, full_hash binary")
    rows = found.drop("partial_hash", "full_hash", "id", "drive_id").join(hashed, "rel_path", "left")
    # Written first: a refresh replaces the very snapshot that the hashes come from.
    return store.write(materialize(rows, "indexed"), drive_id, taken_at, label, mode)


def take(spark: SparkSession, store: Store, root: str, drive_id: int, taken_at: str, label: str | None = None, keep_last: int = 10, keep_monthly: int = 12, **options) -> tuple[int, list[int]]:
    """A new snapshot, after which the drive's old ones are dropped by the usual rule; gives its id and theirs."""
    taken = index(spark, store, root, drive_id, taken_at, label, "snapshot", **options)
    return taken, store.prune(drive_id, taken_at.replace("T", " "), keep_last, keep_monthly)


def confirm(latest: DataFrame, root: str, min_size: int = 1024) -> DataFrame:
    """(id, full_hash): whole-file hashes of the duplicates that have none yet."""
    todo = fill_candidates(latest, min_size).select("id", "rel_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [full_file_digest(os.path.join(root, p)) for p in batch["rel_path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(digests, pa.binary())], names=["id", "full_hash"])

    return map_arrow(todo, run, "id long, full_hash binary").where("full_hash is not null")


def fill(store: Store, drive_id: int, root: str, min_size: int = 1024) -> int:
    """Read the drive's unconfirmed duplicates whole and store their hashes; gives how many."""
    latest = materialize(store.latest(drive_id).withColumn("id", F.col("path_id")), "to-fill")
    found = materialize(confirm(latest, root, min_size).join(latest.select("id", "rel_path"), "id").select("rel_path", "full_hash"), "filled-hashes")
    store.fill_hashes(drive_id, found)
    return found.count()


def reread(spark: SparkSession, store: Store, drive_id: int, root: str) -> DataFrame:
    """The drive's stored files against a new reading: ``verify`` of the latest snapshot."""
    stored = store.latest(drive_id)
    filesystem.register(spark)
    ids = stored.select("rel_path", "path_id")
    found = spark.read.format("foldertree").load(root).where("is_dir = 0").join(ids, "rel_path").withColumn("drive_id", F.lit(drive_id).cast("long"))
    return verify(stored, found)


def stored_folder_hashes(rows: DataFrame) -> DataFrame:
    """(rel_path, hash) of the folders of one stored snapshot, whose links are its paths."""
    ids = materialize(rows.select("rel_path", "parent_path", "is_dir", "full_hash").withColumn("id", F.monotonically_increasing_id()), "folder-ids")
    up = ids.select(F.col("rel_path").alias("parent_path"), F.col("id").alias("parent_id"))
    linked = ids.join(up, "parent_path", "left").select("id", "parent_id", base_name(F.col("rel_path")).alias("name"), "is_dir", F.col("full_hash").alias("hash"))
    return folder_hashes(linked).join(ids.select("id", "rel_path"), "id").select("rel_path", "hash")
