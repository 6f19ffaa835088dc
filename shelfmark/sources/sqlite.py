"""A Spark data source for inventories kept in SQLite files, one per drive."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from shelfmark.runtime import ship

# The tables that can be read, with their columns.
TABLES = {
    "entries_core": "id long, snapshot_id long, path_id long, parent_id long, is_dir int, size long, mtime double, partial_hash binary, full_hash binary, is_symlink int, error string, inode long, device long",
    "entries": "id long, snapshot_id long, rel_path string, path_id long, parent_id long, is_dir int, size long, mtime double, partial_hash binary, full_hash binary, is_symlink int, error string, inode long, device long",
    "paths": "id long, parent_id long, segment string, full_path string",
    "snapshots": "id long, taken_at string, label string, total_files long, total_dirs long, total_size long, hash_version int, opt_one_fs int, opt_skip_cloud int",
    "drive": "id long, label string, root_path string, indexed_at string, total_files long, total_dirs long, total_size long, hash_version int, opt_one_fs int, opt_skip_cloud int",
    "folder_meta": "rel_path string, tags string, note string, updated_at string",
}
#: Rows of a table's rowid range that one task reads.
RANGE = 500_000


class Slice(InputPartition):
    def __init__(self, file: str, low: int, high: int) -> None:
        super().__init__((file, low, high))
        self.file, self.low, self.high = file, low, high


def _open(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], table: str, columns: list[str]) -> None:
        self.files, self.table, self.columns = files, table, columns
        self.snapshot: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("snapshot_id",) and "snapshot_id" in self.columns:
                self.snapshot = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of ids of every readable file; files that aren't inventories are skipped."""
        out: list[InputPartition] = []
        for file in self.files:
            try:
                with _open(file) as con:
                    key = "id" if "id" in self.columns else "rowid"
                    low, high = con.execute(f"SELECT min({key}), max({key}) FROM {self.table}").fetchone()
            except sqlite3.Error:
                continue
            if low is not None:
                out += [Slice(file, at, min(high, at + RANGE - 1)) for at in range(low, high + 1, RANGE)]
        return out or [Slice("", 0, -1)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if not partition.file:
            return
        key = "id" if "id" in self.columns else "rowid"
        where, args = f"{key} BETWEEN ? AND ?", [partition.low, partition.high]
        if self.snapshot is not None:
            where, args = f"{where} AND snapshot_id = ?", [*args, self.snapshot]
        with _open(partition.file) as con:
            have = {r[1] for r in con.execute(f"PRAGMA table_info({self.table})")}
            listed = ", ".join(c if c in have else f"NULL AS {c}" for c in self.columns)
            for row in con.execute(f"SELECT {listed} FROM {self.table} WHERE {where}", args):
                yield (partition.file, *row)


class SqliteInventory(DataSource):
    """``spark.read.format("sqliteinventory").option("table", "entries").load(file or folder)``.

    A folder stands for its *.db files. The first column, ``db``, is the file.
    Columns that an older file lacks are null. An equality on snapshot_id is
    answered by SQLite.
    """

    @classmethod
    def name(cls) -> str:
        return "sqliteinventory"

    def schema(self) -> str:
        table = self.options.get("table", "entries")
        if table not in TABLES:
            raise ValueError(f"unknown table: {table}")
        return f"db string, {TABLES[table]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        import glob
        import os

        path = self.options["path"]
        files = sorted(glob.glob(os.path.join(glob.escape(path), "*.db"))) if os.path.isdir(path) else [path]
        return _Reader(files, self.options.get("table", "entries"), [f.name for f in schema.fields[1:]])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteInventory)
