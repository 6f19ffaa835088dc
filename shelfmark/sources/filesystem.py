"""A Spark data source that walks a folder tree and hashes its files."""

from __future__ import annotations

import fnmatch
import os
import stat
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.functions.hashing import full_file_digest, partial_file_digest
from shelfmark.runtime import ship

SCHEMA = (
    "rel_path string, parent_path string, is_dir int, size long, mtime double, partial_hash binary, full_hash binary, "
    "is_symlink int, error string, inode long, device long"
)

# Folders that systems keep for themselves.
SYSTEM_FOLDERS = {
    ".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems", ".DocumentRevisions-V100", ".PKInstallSandboxManager",
    ".PKInstallSandboxManager-SystemSoftware", ".HFS+ Private Directory Data", ".vol", "System Volume Information", "$RECYCLE.BIN",
}
# Folders of whole system disks that a user may want to leave out; to be given as exclusions.
SYSTEM_DISK_FOLDERS = ("Windows", "Program Files", "Program Files (x86)", "ProgramData", "AppData", "node_modules", "PerfLogs", "Recovery", "$WinREAgent")
# How the names of folders begin that cloud services keep, in lower case.
CLOUD_PREFIXES = (
    "cloudstorage", "mobile documents", "icloud drive", "onedrive", "google drive", "googledrive", "dropbox", "pclouddrive",
    "box sync", "box-box", "creative cloud files", "mega", "megasync", "tresorit", "proton drive", "protondrive",
)


def signed(n: int) -> int:
    """An unsigned 64-bit number as Spark's signed one."""
    return n - (1 << 64) if n >= 1 << 63 else n


@dataclass
class Pruning:
    exclusions: tuple[str, ...] = ()
    skip_cloud: bool = False
    one_fs: bool = False
    root_device: int = 0
    _paths: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        self._paths = tuple(e.strip("/") for e in self.exclusions if "/" in e)

    def drops(self, rel: str, name: str, device: int | None) -> bool:
        """Whether a folder is left out with all below it.

        An exclusion with '/' is a path from the root, one with '*' a pattern of
        names at any depth, any other a name at any depth; case doesn't count in names.
        """
        low = name.lower()
        if name in SYSTEM_FOLDERS or (self.skip_cloud and low.startswith(CLOUD_PREFIXES)):
            return True
        if self.one_fs and device is not None and device != self.root_device:
            return True
        if any(rel == p or rel.startswith(p + "/") for p in self._paths):
            return True
        return any(fnmatch.fnmatchcase(low, e.lower()) if "*" in e else low == e.lower() for e in self.exclusions if "/" not in e)


#: Parts of a tree that are walked side by side, at least where it has as many folders.
UNITS = 64


@dataclass
class Top(InputPartition):
    """One folder with all below it, or (deep=False) the folder and the files directly in it."""

    rel: str
    deep: bool

    def __init__(self, rel: str, deep: bool) -> None:
        super().__init__((rel, deep))
        self.rel, self.deep = rel, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, partial: bool, full: bool, pruning: Pruning) -> None:
        self.root, self.partial, self.full, self.pruning = root, partial, full, pruning

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough to share out, so one large folder is no task of its own."""
        opened, waiting = [], ["."]
        while waiting and len(opened) + len(waiting) < UNITS:
            rel = waiting.pop(0)
            opened.append(Top(rel, False))
            waiting += self._subfolders(rel)
        return [*opened, *(Top(rel, True) for rel in waiting)]

    def _subfolders(self, rel: str) -> list[str]:
        found = []
        with suppress(OSError), os.scandir(os.path.join(self.root, rel)) as entries:
            for e in entries:
                path = e.name if rel == "." else f"{rel}/{e.name}"
                if e.is_dir(follow_symlinks=False) and not self.pruning.drops(path, e.name, e.stat(follow_symlinks=False).st_dev):
                    found.append(path)
        return sorted(found)

    def read(self, partition: Top) -> Iterator[tuple]:
        rel, at = partition.rel, os.path.join(self.root, partition.rel)
        if rel == ".":
            yield (".", None, 1, None, None, None, None, 0, None, None, None)
        else:
            yield self._row(rel, os.path.dirname(rel) or ".", os.stat(at, follow_symlinks=False), None)
        if not partition.deep:
            yield from (r for r in self._folder(rel) if r[2] == 0 or r[7] == 1)
            return
        seen = {(os.stat(at).st_ino, os.stat(at).st_dev)}
        waiting = [rel]
        while waiting:
            for row in self._folder(waiting.pop()):
                yield row
                if row[2] == 1 and row[7] == 0 and (row[9], row[10]) not in seen:
                    seen.add((row[9], row[10]))
                    waiting.append(row[0])

    def _folder(self, rel: str) -> Iterator[tuple]:
        """Rows of what lies directly in a folder; an unreadable folder has none."""
        try:
            entries = sorted(os.scandir(os.path.join(self.root, rel)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = e.name if rel == "." else f"{rel}/{e.name}"
            try:
                info = e.stat(follow_symlinks=False)
            except OSError as x:
                yield (path, rel, 0, None, None, None, None, 0, str(x), None, None)
                continue
            if stat.S_ISDIR(info.st_mode) and self.pruning.drops(path, e.name, info.st_dev):
                continue
            if stat.S_ISDIR(info.st_mode) or stat.S_ISREG(info.st_mode) or stat.S_ISLNK(info.st_mode):
                yield self._row(path, rel, info, e.path)

    def _row(self, rel: str, parent: str, info: os.stat_result, path: str | None) -> tuple:
        place = (signed(info.st_ino), signed(info.st_dev))
        if stat.S_ISLNK(info.st_mode):
            # A link isn't followed; one to a folder is listed as a folder without size.
            folder = bool(path) and os.path.isdir(path)
            return (rel, parent, int(folder), None if folder else 0, info.st_mtime, None, None, 1, None, *place)
        if stat.S_ISDIR(info.st_mode):
            return (rel, parent, 1, None, info.st_mtime, None, None, 0, None, *place)
        partial = partial_file_digest(path, info.st_size) if self.partial else None
        full = full_file_digest(path) if self.full else None
        return (rel, parent, 0, info.st_size, info.st_mtime, partial, full, 0, None, *place)


class FolderTree(DataSource):
    """``spark.read.format("foldertree").load(root)``; some folders with all below them are a partition.

    Options: partial (sampled hash, on by default), full (hash whole files),
    exclusions (JSON list), skip_cloud, one_fs.
    The tree must be visible to the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "foldertree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        import json

        o = self.options
        root = o["path"]
        flag = lambda k, default="false": str(o.get(k, default)).lower() == "true"
        pruning = Pruning(tuple(json.loads(o.get("exclusions", "[]"))), flag("skip_cloud"), flag("one_fs"), os.stat(root).st_dev)
        return _Reader(root, flag("partial", "true"), flag("full"), pruning)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FolderTree)
