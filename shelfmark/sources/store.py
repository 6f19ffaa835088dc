"""The inventory kept as Parquet, partitioned by drive and snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.columns import base_name, parent_path
from shelfmark.operators.diff import snapshot_retention
from shelfmark.operators.hot_keys import with_chunks
from shelfmark.runtime import materialize

_PARTS = ("drive_id", "snapshot_id")
_PATHS = "id long, full_path string"
_DRIVES = "id long, label string, root_path string, hash_version int"
_SNAPSHOTS = "drive_id long, snapshot_id long, taken_at string, label string"

#: What analysis expects of a row, with its type; a snapshot without a column has nulls there.
_ROW = {
    "is_dir": "int", "size": "bigint", "mtime": "double", "partial_hash": "binary", "full_hash": "binary", "is_symlink": "int", "error": "string", "inode": "bigint", "device": "bigint",
}

#: Bits of an id that number the paths, and the snapshots of a drive.
_PATH_BITS, _SNAPSHOT_BITS = 38, 12


def is_store(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/entries")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


class Store:
    """Snapshots of drives under one folder: ``entries`` (partitioned), ``snapshots``, ``paths`` and ``drives``.

    Writes replace whole partitions, so that a repeated or retried write of a
    snapshot leaves it once. A path has one number in all snapshots. One process
    writes at a time.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        if schema and not self._fs().exists(self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def entries(self) -> DataFrame:
        return self._read("entries")

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", _SNAPSHOTS)

    def latest_id(self, drive_id: int) -> int | None:
        return self.snapshots().where(F.col("drive_id") == drive_id).agg(F.max("snapshot_id")).first()[0]

    def latest(self, drive_id: int) -> DataFrame:
        """The rows of a drive's latest snapshot; without one, none."""
        last = self.latest_id(drive_id)
        return self.entries().where((F.col("drive_id") == drive_id) & (F.col("snapshot_id") == (last or 0)))

    def name_drive(self, drive_id: int, label: str | None, root_path: str | None) -> None:
        """Add a drive to the list, or change it there."""
        others = self._read("drives", _DRIVES).where(F.col("id") != drive_id)
        mine = self.spark.createDataFrame([(drive_id, label, root_path, 2)], _DRIVES)
        # Written first, since it replaces what it reads.
        materialize(others.unionByName(mine), "drives").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/drives")

    def drives(self) -> DataFrame:
        return self._read("drives", _DRIVES)

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``path_id``; paths not seen before are numbered on and added to the list."""
        known = self._read("paths", _PATHS)
        own = rows.where("rel_path is not null").select(F.col("rel_path").alias("full_path")).distinct()
        new = own.join(known, "full_path", "left_anti").withColumn("all", F.lit(1))
        last = known.agg(F.max("id")).first()[0] or 0
        added = materialize(with_chunks(new, ["all"], 1).select((F.col("chunk") + 1 + last).alias("id"), "full_path"), "new-paths")
        added.write.mode("append").parquet(f"{self.folder}/paths")
        ids = known.unionByName(added).select(F.col("id").alias("path_id"), F.col("full_path").alias("rel_path"))
        return rows.join(ids, "rel_path", "left")

    def write(self, rows: DataFrame, drive_id: int, taken_at: str, label: str | None = None, mode: str = "snapshot") -> int:
        """Store ``rows`` (rel_path, ...) as a snapshot and give its id, which is the drive's own count.

        'snapshot' adds one, 'refresh' rewrites the latest under its id (or adds the
        first), 'fresh' drops all the drive's snapshots first. Of several rows with
        one rel_path, that of the highest (mtime, inode) stays.
        """
        if mode not in ("snapshot", "refresh", "fresh"):
            raise ValueError(f"unknown mode: {mode}")
        last = self.latest_id(drive_id)
        if mode == "fresh" and last is not None:
            self.delete(drive_id, [r[0] for r in self.snapshots().where(F.col("drive_id") == drive_id).select("snapshot_id").collect()])
            last = None
        snapshot = last if mode == "refresh" and last is not None else (last or 0) + 1
        rest = [c for c in rows.columns if c not in ("rel_path", "mtime", "inode", "path_id", *_PARTS)]
        one = rows.groupBy("rel_path").agg(F.max(F.struct("mtime", "inode", *rest)).alias("r")).select("rel_path", *[F.col(f"r.{c}").alias(c) for c in ("mtime", "inode", *rest)])
        stored = self._numbered(materialize(one, "snapshot")).withColumns({"drive_id": F.lit(drive_id).cast("long"), "snapshot_id": F.lit(snapshot).cast("long")})
        self._replace(stored, "entries")
        meta = self.spark.range(1).select(F.lit(drive_id).cast("long").alias("drive_id"), F.lit(snapshot).cast("long").alias("snapshot_id"), F.lit(taken_at).alias("taken_at"), F.lit(label).cast("string").alias("label"))
        self._replace(meta, "snapshots")
        return snapshot

    def _replace(self, rows: DataFrame, table: str) -> None:
        """Put ``rows`` in place of the partitions that they are in; the committer moves whole partitions."""
        rows.write.partitionBy(*_PARTS).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.folder}/{table}")

    def fill_hashes(self, drive_id: int, hashes: DataFrame) -> None:
        """Store whole-file hashes (rel_path, full_hash) in the drive's latest snapshot, where it has none."""
        rows = self.latest(drive_id).join(hashes.select("rel_path", F.col("full_hash").alias("_filled")), "rel_path", "left")
        filled = rows.withColumn("full_hash", F.coalesce("full_hash", "_filled")).drop("_filled")
        self._replace(materialize(filled, "filled"), "entries")

    def delete(self, drive_id: int, snapshot_ids: list[int]) -> None:
        for s in snapshot_ids:
            for table in ("entries", "snapshots"):
                self._fs().delete(self._path(f"{table}/drive_id={drive_id}/snapshot_id={s}"), True)

    def prune(self, drive_id: int, as_of: str, keep_last: int = 10, keep_monthly: int = 12, force: bool = False) -> list[int]:
        """Drop what the retention rule doesn't keep; refuses to drop everything unless forced."""
        mine = self.snapshots().where(F.col("drive_id") == drive_id).withColumnRenamed("snapshot_id", "id")
        decided = snapshot_retention(mine, as_of, keep_last, keep_monthly).collect()
        gone = sorted(r.snapshot_id for r in decided if not r.keep)
        if gone and len(gone) == len(decided) and not force:
            raise ValueError("the rule keeps no snapshot")
        self.delete(drive_id, gone)
        return gone

    def compact(self, drive_id: int, snapshot_id: int, files: int = 1) -> None:
        """Rewrite a snapshot's partition into ``files`` files, sorted by path.

        The rows are copied to the scratch folder before the partition is replaced, so
        that a failure leaves the old files or the new ones.
        """
        rows = self.entries().where((F.col("drive_id") == drive_id) & (F.col("snapshot_id") == snapshot_id))
        copy = materialize(rows, "compact")
        self._replace(copy.repartitionByRange(files, "rel_path").sortWithinPartitions("rel_path"), "entries")

    def tables(self) -> dict[str, DataFrame]:
        """The store as the tables that analysis reads: entries_core, snapshots, paths, drive.

        Ids are unique over all drives: a snapshot's is made of its drive's and its own
        number, a row's of its snapshot's and its path's.
        """
        paths = self._read("paths", _PATHS)
        up = paths.select(F.col("id").alias("parent_id"), F.col("full_path").alias("up"))
        linked = paths.withColumn("up", F.when(F.col("full_path") != ".", parent_path(F.col("full_path")))).join(up, "up", "left")
        snapshot_id = F.shiftleft(F.col("drive_id").cast("long"), _SNAPSHOT_BITS).bitwiseOR(F.col("snapshot_id").cast("long"))
        rows, has = self.entries(), set(self.entries().columns)
        above = linked.select(F.col("id").alias("path_id"), F.col("parent_id").alias("path_parent"))
        entries = rows.select(F.col("drive_id").cast("long").alias("drive_id"), snapshot_id.alias("snapshot_id"), "path_id", *[(F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in _ROW.items()])

        def row_id(path: str):
            return F.shiftleft("snapshot_id", _PATH_BITS).bitwiseOR(F.col(path))

        at = self.snapshots().select(snapshot_id.alias("id"), F.col("drive_id").cast("long").alias("drive_id"), "taken_at", "label")
        listed = self.drives()
        unnamed = at.select(F.col("drive_id").alias("id")).distinct().join(listed, "id", "left_anti")
        return {
            "entries_core": entries.join(above, "path_id", "left").select(
                row_id("path_id").alias("id"), row_id("path_parent").alias("parent_id"), *entries.columns, F.lit(None).cast(T.TimestampType()).alias("loaded_at")
            ),
            "snapshots": at,
            "paths": linked.select("id", "parent_id", base_name(F.col("full_path")).alias("segment"), "full_path"),
            "drive": listed.unionByName(unnamed, allowMissingColumns=True),
        }
