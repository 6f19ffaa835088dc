"""Tags and notes, reuse of hashes, re-verification, and checks of the inventory's health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.columns import same_mtime
from shelfmark.functions.text import with_nfc
from shelfmark.tables import current_rows


def parsed_tags(folder_meta: DataFrame) -> DataFrame:
    """``folder_meta`` with ``tags`` as a list; empty or broken text gives an empty one."""
    return folder_meta.withColumn("tags", F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")))


def tag_search(folder_meta: DataFrame, text: str) -> DataFrame:
    """Folders whose path, note or a tag contains ``text``, whatever the case."""
    q = F.lit(text.lower())
    hit = F.exists("tags", lambda t: F.contains(F.lower(t), q)) | F.contains(F.lower("rel_path"), q) | F.contains(F.lower(F.coalesce("note", F.lit(""))), q)
    return parsed_tags(folder_meta).where(hit).select("drive_id", "rel_path", F.array_join("tags", "|").alias("tags"), "note")


def upsert_meta(folder_meta: DataFrame, changes: DataFrame) -> DataFrame:
    """``folder_meta`` with the rows of ``changes`` in place of those of the same drive and path."""
    return folder_meta.join(changes.select("drive_id", "rel_path").distinct(), ["drive_id", "rel_path"], "left_anti").unionByName(changes)


def reuse_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of ``new`` whose hashes can be taken from ``old``: same path but for its form, size, and time.

    Of several old rows of one path, the one with the lowest path and id counts.
    """
    usable = old.where("is_dir = 0 and error is null and coalesce(is_symlink, 0) = 0 and partial_hash is not null and size is not null and mtime is not null")
    cache = (
        with_nfc(usable, "rel_path", "form")
        .groupBy("drive_id", "form")
        .agg(F.min(F.struct("rel_path", "id", "size", "mtime", "partial_hash", "full_hash")).alias("c"))
    )
    files = with_nfc(new.where("is_dir = 0 and coalesce(is_symlink, 0) = 0"), "rel_path", "form")
    return (
        files.join(cache, ["drive_id", "form"])
        .where((F.col("size") == F.col("c.size")) & same_mtime(F.col("mtime"), F.col("c.mtime")))
        .select("drive_id", "id", F.col("c.id").alias("from_id"), F.col("c.partial_hash").alias("partial_hash"), F.col("c.full_hash").alias("full_hash"))
    )


def verify(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(drive_id, status, n): stored files against a new reading (drive_id, path_id, size, partial_hash, error).

    'missing', 'unreadable', 'size_changed', 'corrupted' (same size, other hash) or 'ok'.
    """
    a = stored.where("is_dir = 0 and error is null and coalesce(is_symlink, 0) = 0 and partial_hash is not null").select("drive_id", "path_id", "size", "partial_hash")
    b = found.select("drive_id", "path_id", F.col("size").alias("size_now"), F.col("partial_hash").alias("hash_now"), F.col("error").alias("error_now"), F.lit(1).alias("seen"))
    status = (
        F.when(F.col("seen").isNull(), "missing")
        .when(F.col("error_now").isNotNull() | F.col("hash_now").isNull(), "unreadable")
        .when(~F.col("size").eqNullSafe(F.col("size_now")), "size_changed")
        .when(F.col("partial_hash") != F.col("hash_now"), "corrupted")
        .otherwise("ok")
    )
    return a.join(b, ["drive_id", "path_id"], "left").groupBy("drive_id", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def health_checks(drives: DataFrame, snapshots: DataFrame, paths: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, ok, n_bad): checks of the tables against each other; ``entries`` as delivered.

    hash_version: drives that don't say 2; labels: drives without one;
    snapshot_times: times that can't be read; orphan_paths: rows that name a path
    which isn't listed; unlisted_snapshots: rows of unknown snapshots; file_sizes: files
    without error and size; hash_coverage: sized files without a partial hash, ok
    below one in twenty.
    """

    def check(df: DataFrame, name: str, bad, allowed=F.lit(0)) -> DataFrame:
        n = F.count_if(bad)
        return df.agg(n.alias("n_bad"), (n <= allowed).alias("ok")).select(F.lit(name).alias("name"), "ok", "n_bad")

    files = entries.where("is_dir = 0 and error is null and coalesce(is_symlink, 0) = 0")
    sized = files.where("size is not null")
    at = F.try_to_timestamp("taken_at", F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    orphans = entries.where("path_id is not null").join(paths.select(F.col("id").alias("path_id")), "path_id", "left_anti")
    unlisted = entries.join(snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti")
    parts = [
        check(drives, "hash_version", ~F.col("hash_version").eqNullSafe(F.lit(2))),
        check(drives, "labels", F.col("label").isNull()),
        check(snapshots, "snapshot_times", at.isNull()),
        check(orphans, "orphan_paths", F.lit(True)),
        check(unlisted, "unlisted_snapshots", F.lit(True)),
        check(files, "file_sizes", F.col("size").isNull()),
        check(sized, "hash_coverage", F.col("partial_hash").isNull(), F.count(F.lit(1)) / 20),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entry_counts(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """(drive_id, snapshot_id, ok, total_files, n_files, total_dirs, n_dirs): recorded totals against current rows.

    Folders may differ by 1, files (without links) by 5 %; a total that is null,
    or 0 files, isn't compared. A snapshot that records something and has no rows
    is never ok.
    """
    link = F.coalesce("is_symlink", F.lit(0)) != 0
    found = (
        current_rows(entries, "snapshot_id", "path_id", "is_dir", "is_symlink")
        .groupBy(F.col("snapshot_id").alias("id"))
        .agg(F.count_if((F.col("is_dir") == 0) & ~link).alias("n_files"), F.count_if(F.col("is_dir") == 1).alias("n_dirs"), F.count(F.lit(1)).alias("n"))
    )
    files, dirs = F.coalesce("total_files", F.lit(0)), F.coalesce("total_dirs", F.lit(0))
    near = ((files <= 0) | (F.abs(F.col("n_files") - files) * 20 <= files)) & (F.col("total_dirs").isNull() | (F.abs(F.col("n_dirs") - dirs) <= 1))
    empty = (F.col("n") == 0) & ((files > 0) | (dirs > 0))
    return (
        snapshots.join(found, "id", "left")
        .fillna(0, ["n_files", "n_dirs", "n"])
        .select("drive_id", F.col("id").alias("snapshot_id"), (near & ~empty).alias("ok"), "total_files", "n_files", "total_dirs", "n_dirs")
    )
