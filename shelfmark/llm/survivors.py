"""One surviving record per group of duplicates, chosen field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.tables import latest_file_rows


@dataclass(frozen=True)
class Attribute:
    """A field of the survivor: its value, and what ranks the rows that offer one.

    Rows whose value isn't null come first, then those of the highest ``ranks``
    (source priority, completeness, time, ...; nulls lowest), then the highest
    value. ``optional`` lets a row with a null value win by rank.
    """

    value: Column
    ranks: tuple[Column, ...] = ()
    optional: bool = False


def survivors(rows: DataFrame, key: list[str], attributes: dict[str, Attribute], copy: list[Column]) -> DataFrame:
    """One row per key with at least two copies: the key and the best value of each attribute.

    A single aggregation takes the maximum of (value isn't null, ranks, value) for
    each attribute, which every executor reduces for its own rows first, so that a
    key with most of the rows costs no more than others. Rows with equal ``copy``
    columns are one copy; whether a key has two is read from their least and
    greatest value in the same aggregation. Rows with a null in the key are left
    out. An empty input gives an empty result.
    """
    best = []
    for name, a in attributes.items():
        given = F.lit(True) if a.optional else a.value.isNotNull()
        parts = [given.alias("given"), *[r.alias(f"rank{i}") for i, r in enumerate(a.ranks)], a.value.alias("value")]
        best.append(F.max(F.struct(*parts)).alias(name))
    identity = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(copy)])
    known = rows.dropna(subset=key)
    grouped = known.groupBy(*key).agg(F.min(identity).alias("_first"), F.max(identity).alias("_last"), *best)
    return grouped.where(~F.col("_first").eqNullSafe(F.col("_last"))).select(*key, *[F.col(f"{n}.value").alias(n) for n in attributes])


def _content_rows(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """File rows of all latest snapshots with a full hash, with what ranks them."""
    rows = latest_file_rows(entries, snapshots, "id", "path_id", "size", "mtime", "inode", "device", "full_hash").where("full_hash is not null")
    usable = (F.col("mtime") > 0) & (F.col("mtime") <= F.col("taken_s"))
    linked = F.col("inode").isNotNull() & F.col("device").isNotNull()
    return (
        rows.withColumn("good_mtime", F.when(usable, F.col("mtime")))
        .withColumn("linked", linked)
        .withColumn("complete", F.col("good_mtime").isNotNull().cast("int") + linked.cast("int"))
        # A row without inode or device is a copy of its own.
        .withColumn("own", F.when(~linked, F.col("id")))
        .withColumn("content", F.lower(F.hex("full_hash")))
    )


_COPY = ("drive_id", "inode", "device", "own")


def _copy() -> list[Column]:
    linked = F.col("linked")
    return [F.when(linked | (F.lit(c) == "own"), F.col(c)) for c in _COPY]


def surviving_entries(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(full_hash, keep_id): the row to keep of each content that has two copies or more.

    Most complete (usable mtime; inode with device), then latest usable mtime, then
    lowest id. An mtime is usable if it is above 0 and not after the snapshot.
    """
    keep = Attribute(F.col("id"), (F.col("complete"), F.col("good_mtime"), -F.col("id")))
    found = survivors(_content_rows(entries, snapshots), ["content"], {"keep_id": keep}, _copy())
    return found.select(F.col("content").alias("full_hash"), "keep_id")


def golden_entries(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One record built per content with two copies or more, each field from the best row for it.

    mtime: the latest usable one; inode, device and drive_id: from the row with both
    of the latest snapshot; size and path_id: from the latest snapshot that has
    them; ties go to the lowest id. Fields that no row has are null.
    """
    recent = (F.col("taken_s"), -F.col("id"))
    place = F.when(F.col("linked"), F.struct("drive_id", "inode", "device"))
    built = survivors(
        _content_rows(entries, snapshots),
        ["content"],
        {
            "mtime": Attribute(F.col("good_mtime"), (F.col("good_mtime"),)),
            "place": Attribute(place, recent),
            "size": Attribute(F.col("size"), recent),
            "path_id": Attribute(F.col("path_id"), recent),
        },
        _copy(),
    )
    return built.select(F.col("content").alias("full_hash"), "mtime", "place.drive_id", "place.inode", "place.device", "size", "path_id")
