"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.tables import current_rows, delivered_snapshots


def changes_between_deliveries(rows: DataFrame, scope: list[str], key: list[str], values: list[str]) -> DataFrame:
    """Added, removed and changed keys between consecutive deliveries, all at once.

    ``rows`` has one row per key and delivery, with the delivery's number ``idx``
    within its scope (from 1, without gaps), its ``snapshot_id``, and ``next_id``,
    the id of the delivery after it (null for the last). Each key's rows are put in
    order of ``idx``: a lag that isn't the number before means an addition, a lead
    that isn't the number after means a removal at ``next_id``, and differing
    values against the row before mean a change. One shuffle on (scope, key)
    serves any number of snapshots, and a key has at most one row per delivery.

    Nulls: a null value differs from a value and equals a null. A scope's first
    delivery yields nothing. An empty input gives an empty result.
    """
    order = Window.partitionBy(*scope, *key).orderBy("idx")
    held = F.struct(*values)
    marked = rows.select(
        *scope, *key, "idx", "snapshot_id", "next_id", held.alias("now"),
        F.lag("idx").over(order).alias("was_idx"),
        F.lag(held).over(order).alias("was"),
        F.lead("idx").over(order).alias("will_idx"),
    )
    follows = F.col("was_idx") == F.col("idx") - 1
    none = F.lit(None).cast("struct<snapshot_id:bigint,change:string>")

    def event(at: str, kind: str):
        return F.struct(F.col(at).cast("long").alias("snapshot_id"), F.lit(kind).alias("change"))

    here = (
        F.when((F.col("idx") > 1) & ~F.coalesce(follows, F.lit(False)), event("snapshot_id", "added"))
        .when(follows & ~F.col("now").eqNullSafe(F.col("was")), event("snapshot_id", "changed"))
        .otherwise(none)
    )
    gone = F.when(
        F.col("next_id").isNotNull() & ~F.coalesce(F.col("will_idx") == F.col("idx") + 1, F.lit(False)),
        event("next_id", "removed"),
    ).otherwise(none)
    return marked.select(*scope, *key, F.explode(F.array_compact(F.array(here, gone))).alias("e")).select(
        *scope, "e.snapshot_id", *key, "e.change"
    )


def snapshot_changes(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, path_id, change) of every file between consecutive delivered snapshots.

    Files are the current rows with ``is_dir = 0``; a path that turns from file to
    folder is removed. ``size`` and ``partial_hash`` decide on a change. Rows with
    a null snapshot_id or path_id are left out, as are rows of unlisted snapshots.
    """
    delivered = delivered_snapshots(entries, snapshots).select("snapshot_id", "drive_id", "idx", "next_id")
    files = (
        current_rows(entries, "snapshot_id", "path_id", "is_dir", "size", "partial_hash")
        .where("is_dir = 0")
        .drop("is_dir")
        .join(delivered, "snapshot_id")
    )
    return changes_between_deliveries(files, ["drive_id"], ["path_id"], ["size", "partial_hash"]).drop("drive_id")
