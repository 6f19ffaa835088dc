"""Comparisons across drives: pairs, common contents, overlap, and contents held once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.columns import parent_path, physical_copy
from shelfmark.operators.duplicates import hex_of
from shelfmark.runtime import materialize

KEY = ("size", "partial_hash")


def _hashed(latest: DataFrame, min_size: int) -> DataFrame:
    return latest.where(f"is_dir = 0 and size >= {min_size} and partial_hash is not null")


def _looked_up(a: DataFrame, b: DataFrame, min_size: int, by: list[str]) -> DataFrame:
    """Files of A with how many of B share the key, lack a full hash, or have the same one, and the first such path.

    B is reduced to its keys and full hashes first; pairs of files are never made.
    """
    y, key = _hashed(b, min_size), [*by, *KEY]
    open_ = F.col("full_hash").isNull()
    keys = y.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(open_).alias("n_open"), F.min("rel_path").alias("first_all"), F.min(F.when(open_, F.col("rel_path"))).alias("first_open")
    )
    same = y.where("full_hash is not null").groupBy(*key, "full_hash").agg(F.count(F.lit(1)).alias("n_same"), F.min("rel_path").alias("first_same"))
    j = _hashed(a, min_size).join(keys, key, "left").join(same, [*key, "full_hash"], "left")
    n = F.when(open_, F.col("n_all")).otherwise(F.col("n_open") + F.coalesce("n_same", F.lit(0)))
    return j.withColumns({
        "n_in_b": F.coalesce(n, F.lit(0)), "confirmed": F.col("n_same").isNotNull(),
        "first_in_b": F.when(open_, F.col("first_all")).otherwise(F.coalesce("first_same", "first_open")),
    })


def compare_matches(a: DataFrame, b: DataFrame, min_size: int = 1024, by: Sequence[str] = ()) -> DataFrame:
    """Files of A that B has: how many files of B match, the first of them, and whether by full hash.

    A match has the same key and a full hash that doesn't contradict. The first
    match is that of the same full hash where there is one, then of the lowest path.
    """
    by = list(by)
    return _looked_up(a, b, min_size, by).where("n_in_b > 0").select(*by, "id", "rel_path", "size", "n_in_b", "first_in_b", "confirmed")


def compare_summary(a: DataFrame, b: DataFrame, min_size: int = 1024, by: Sequence[str] = ()) -> DataFrame:
    """Files of A with a match in B, their bytes, how many are confirmed, and files whose key B lacks; and the same in pairs.

    A pair is a file of A with one of B that matches; pairs are counted, not made. A
    file whose key matches but whose full hash contradicts is in none. One row, or
    with ``by`` one for each value that A has.
    """
    match, lacking, size = F.col("n_in_b") > 0, F.col("n_all").isNull(), F.col("size")

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return _looked_up(a, b, min_size, list(by)).groupBy(*by).agg(
        F.count_if(match).alias("matched_files"), total(F.when(match, size)).alias("matched_bytes"), F.count_if(match & F.col("confirmed")).alias("confirmed_files"),
        F.count_if(lacking).alias("only_in_a"), total(F.when(lacking, size)).alias("only_in_a_bytes"),
        total("n_in_b").alias("pairs"), total(F.col("n_in_b") * size).alias("pair_bytes"), total("n_same").alias("confirmed_pairs"),
    )


def only_in_a(a: DataFrame, b: DataFrame, min_size: int = 1024, by: Sequence[str] = ()) -> DataFrame:
    """Files of A whose key no file of B has."""
    return _hashed(a, min_size).join(_hashed(b, min_size), [*by, *KEY], "left_anti").select(*by, "id", "rel_path", "size")


def paired(latest: DataFrame, pairs: DataFrame, drives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files of both sides of all pairs of drives (pair_id, label_a, label_b), with ``pair_id``.

    A label names the drive of that label with the lowest id; a pair with a side
    that no drive has is left out.
    """
    ids = drives.where("label is not null").groupBy("label").agg(F.min("id").alias("drive_id"))
    known = pairs.join(ids.select(F.col("label").alias("label_a"), F.col("drive_id").alias("a")), "label_a").join(ids.select(F.col("label").alias("label_b"), F.col("drive_id").alias("b")), "label_b")
    sides = materialize(known.select("pair_id", "a", "b"), "pairs")
    return tuple(latest.join(sides.select("pair_id", F.col(s).alias("drive_id")), "drive_id") for s in ("a", "b"))


def _copies(latest: DataFrame, min_size: int) -> DataFrame:
    """One row per physical file of a drive and key; hard links count once."""
    copy = physical_copy(F.col("inode"), F.col("device"), F.col("id"))
    return (
        _hashed(latest, min_size)
        .withColumn("copy", copy)
        .groupBy("drive_id", *KEY, "copy")
        .agg(F.min(F.struct("rel_path", "id", "full_hash")).alias("f"))
        .select("drive_id", *KEY, F.col("f.rel_path").alias("rel_path"), F.col("f.id").alias("id"), F.col("f.full_hash").alias("full_hash"))
    )


def _per_drive(copies: DataFrame) -> DataFrame:
    """Copies per key, full hash and drive, with what the whole key has.

    The windows run over rows reduced to one per full hash and drive.
    """
    key = Window.partitionBy(*KEY)
    rows = copies.groupBy(*KEY, "full_hash", "drive_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.length("rel_path").alias("l"), "rel_path")).alias("short")
    )
    return (
        rows.withColumn("key_drives", F.size(F.collect_set("drive_id").over(key)))
        .withColumn("open", F.count_if(F.col("full_hash").isNull()).over(key) > 0)
        .withColumn("sub", F.when(~F.col("open") & (F.col("key_drives") > 1), F.col("full_hash")))
    )


def cross_groups(latest: DataFrame, min_size: int = 1 << 20) -> DataFrame:
    """Contents on two drives or more; confirmed where every copy of the key has a full hash."""
    rows = _per_drive(_copies(latest, min_size)).where("key_drives > 1")
    per_drive = rows.groupBy(*KEY, "open", "sub", "drive_id").agg(F.sum("n").alias("n"))
    groups = per_drive.groupBy(*KEY, "open", "sub").agg(
        F.count(F.lit(1)).alias("n_drives"), F.sum("n").alias("n_copies"), F.count_if(F.col("n") > 1).alias("n_intra"),
        F.array_join(F.array_sort(F.collect_list("drive_id").cast("array<bigint>")).cast("array<string>"), "|").alias("drives"),
    )
    return groups.where("n_drives > 1").select(
        "size", hex_of("partial_hash").alias("partial"), hex_of("sub").alias("full"), (~F.col("open")).alias("confirmed"), "n_drives", "n_copies", "n_intra", "drives",
        (F.col("size") * (F.col("n_copies") - 1)).alias("wasted_bytes"),
    )


def cross_copies(latest: DataFrame, min_size: int = 1 << 20) -> DataFrame:
    """The copies of the groups of :func:`cross_groups`."""
    copies = _copies(latest, min_size)
    rows = _per_drive(copies).where("key_drives > 1")
    wide = rows.groupBy(*KEY, "open", "sub").agg(F.countDistinct("drive_id").alias("n_drives")).where("n_drives > 1").select(*KEY, "open", F.col("sub").alias("g"))
    j = copies.join(wide, list(KEY)).where(F.col("open") | F.col("full_hash").eqNullSafe(F.col("g")))
    return j.select("size", hex_of("partial_hash").alias("partial"), hex_of("g").alias("full"), "drive_id", "rel_path", "id")


def overlap_matrix(latest: DataFrame, min_size: int = 1 << 20) -> DataFrame:
    """Bytes of the contents that each two drives share, each content once, in both orders."""
    rows = _per_drive(_copies(latest, min_size)).where("key_drives > 1").select(*KEY, "open", "sub", "drive_id").distinct()
    # A content is on few drives: pairs are taken of the drives of a content, not of its copies.
    listed = rows.groupBy(*KEY, "open", "sub").agg(F.collect_list("drive_id").alias("d"))
    return (
        listed.select("size", F.explode("d").alias("drive_a"), "d")
        .select("size", "drive_a", F.explode("d").alias("drive_b"))
        .where("drive_a <> drive_b")
        .groupBy("drive_a", "drive_b")
        .agg(F.sum("size").alias("bytes"))
    )


def single_copies(latest: DataFrame, min_size: int = 1 << 20) -> DataFrame:
    """Contents held by one drive only, one row each: drive, shortest path, size, copies inside.

    A key on several drives is at risk only where all its copies have full hashes
    and a full hash is on one drive; without full hashes it counts as backed up.
    With fewer than two drives nothing can be said, and there are no rows.
    """
    rows = _per_drive(_copies(latest, min_size))
    groups = rows.where("key_drives = 1 or not open").groupBy(*KEY, "sub").agg(
        F.countDistinct("drive_id").alias("n_drives"), F.min("drive_id").alias("drive_id"), F.min("short").alias("short"), F.sum("n").alias("internal_copies")
    )
    several = latest.agg(F.min("drive_id") < F.max("drive_id")).scalar()
    return (
        groups.where("n_drives = 1")
        .where(several)
        .select("drive_id", F.col("short.rel_path").alias("path"), "size", "internal_copies")
    )


def single_copies_by_drive(items: DataFrame) -> DataFrame:
    return items.groupBy("drive_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def single_copies_by_folder(items: DataFrame, limit: int = 40) -> DataFrame:
    """The ``limit`` folders with most bytes at risk."""
    per = items.groupBy("drive_id", parent_path(F.col("path")).alias("folder")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.desc("bytes"), "drive_id", "folder").limit(limit)
