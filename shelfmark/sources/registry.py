"""The list of drives, rules from files, and recognising a drive by what is on it."""

from __future__ import annotations

import glob
import json
import os
import re
import sqlite3
import string
import unicodedata
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.folders import TAG_RULES
from shelfmark.sources.sqlite import _open


def classify(file: str) -> str:
    """'ok', 'empty' (no snapshot), 'partial' (a snapshot without entries), 'no_drive' or 'unreadable'."""
    try:
        with _open(file) as con:
            tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
            if "drive" not in tables or not con.execute("SELECT count(*) FROM drive").fetchone()[0]:
                return "no_drive"
            if "snapshots" not in tables or not con.execute("SELECT count(*) FROM snapshots").fetchone()[0]:
                return "empty"
            rows = "entries_core" if "entries_core" in tables else "entries"
            return "ok" if con.execute(f"SELECT EXISTS (SELECT 1 FROM {rows})").fetchone()[0] else "partial"
    except sqlite3.Error:
        return "unreadable"


def import_folder(folder: str, registered: set[str] = frozenset()) -> list[tuple[str, str]]:
    """(file, state) of the *.db files directly in a folder; those known are 'registered'."""
    files = sorted(glob.glob(os.path.join(glob.escape(folder), "*.db")))
    return [(f, "registered" if f in registered else classify(f)) for f in files]


def rename_drive(drives: DataFrame, drive_id: int, label: str) -> DataFrame:
    return drives.withColumn("label", F.when(F.col("id") == drive_id, F.lit(label)).otherwise(F.col("label")))


def drop_drive(drives: DataFrame, drive_id: int) -> DataFrame:
    return drives.where(F.col("id") != drive_id)


def tag_rules(file: str | Path | None = None) -> dict[str, tuple[str, ...]]:
    """Tags and extensions from a YAML file {tag: [extension, ...]}; the defaults where it is missing or wrong."""
    try:
        import yaml

        data = yaml.safe_load(Path(file).read_text(encoding="utf-8"))
        rules = {str(tag): tuple(e for e in (str(x).lower().lstrip(".").strip() for x in exts) if e) for tag, exts in data.items() if exts}
        return {tag: exts for tag, exts in rules.items() if exts} or TAG_RULES
    except Exception:
        return TAG_RULES


def write_tag_rules(file: str | Path, overwrite: bool = False) -> None:
    """The default rules as a YAML file to edit; one that is there stays unless ``overwrite``."""
    if overwrite or not Path(file).exists():
        lines = [f"{json.dumps(tag, ensure_ascii=False)}: {json.dumps(exts, ensure_ascii=False)}" for tag, exts in TAG_RULES.items()]
        Path(file).write_text("\n".join(["# tag: [extensions]", *lines, ""]), encoding="utf-8")


def differing_hash_versions(drives: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, version_a, version_b) of the pairs of drives whose partial hashes can't be compared."""
    side = drives.where("label is not null").groupBy("label").agg(F.min_by("hash_version", "id").alias("v"))
    a, b = (side.select(F.col("label").alias(f"label_{s}"), F.col("v").alias(f"version_{s}")) for s in "ab")
    return pairs.join(a, "label_a").join(b, "label_b").where("not (version_a <=> version_b)").select("pair_id", "version_a", "version_b")


def fingerprint(latest: DataFrame, names: int = 12, files: int = 8) -> tuple[list[str], list[tuple[str, int]]]:
    """Names at the top of a drive, folders and large files first, and its largest readable files with their sizes."""
    top = latest.where("not contains(rel_path, '/') and not contains(rel_path, '\\\\') and rel_path <> '.'")
    readable = " and ".join(["is_dir = 0", "size > 0", *(c for c, test in (("coalesce(is_symlink, 0) = 0", "is_symlink"), ("error is null", "error")) if test in latest.columns)])
    by_rank = top.groupBy("rel_path").agg(F.max(F.struct("is_dir", "size")).alias("r")).orderBy(F.desc("r"), "rel_path").limit(names)
    big = latest.where(readable).orderBy(F.desc("size"), "rel_path").limit(files).select("rel_path", "size")
    return [r[0] for r in by_rank.collect()], [(r[0].replace("\\", "/"), r[1]) for r in big.collect()]


def _size_at(root: str, path: str) -> int | None:
    """Size of what is at a path, by its stored name or the composed one; None if nothing is."""
    for name in (path, unicodedata.normalize("NFC", path)):
        try:
            return os.stat(os.path.join(root, name)).st_size
        except OSError:
            continue
    return None


def root_hits(root: str, names: list[str], files: list[tuple[str, int]]) -> int:
    """How much of a fingerprint a folder shows; 0 where that is too little to take it for the drive.

    Enough are half of the names (two at least, or the only one), and with files a
    file of its size.
    """
    named = sum(_size_at(root, n) is not None for n in names)
    sized = sum(_size_at(root, p) == n for p, n in files)
    least = min(len(names), max(2, -(-len(names) // 2)))
    return named + sized if named >= least and (sized or not files) else 0


def matches_root(root: str, names: list[str], files: list[tuple[str, int]]) -> bool:
    """Whether a mounted folder is the drive of this fingerprint."""
    return root_hits(root, names, files) > 0


# Where systems mount volumes, with the number of names that lead to a volume.
MOUNTS = {"/Volumes": (1,), "/mnt": (1,), "/media": (1, 2), "/run/media": (2,)}


def paths_in_volume(root: str) -> list[str]:
    """What an indexed root may be called below its volume; nothing for a whole volume or an unknown place."""
    drive = re.fullmatch(r"[A-Za-z]:[/\\]+(.+?)[/\\]*", root)
    if drive:
        return [drive[1].replace("\\", "/")]
    parts = PurePosixPath(root).parts
    places = [(len(PurePosixPath(m).parts) + n) for m, depths in MOUNTS.items() if PurePosixPath(root).is_relative_to(m) for n in depths]
    return ["/".join(parts[n:]) for n in places if len(parts) > n]


def mounted_volumes() -> list[str]:
    """Folders at which a volume may be mounted here."""
    levels = [f"{m}{'/*' * n}/" for m, depths in MOUNTS.items() for n in depths]
    letters = [f"{c}:\\" for c in string.ascii_uppercase] if os.name == "nt" else []
    return [v.rstrip("/") for pattern in levels for v in sorted(glob.glob(pattern))] + [v for v in letters if os.path.isdir(v)]


def resolve_root(latest: DataFrame, stored_root: str, candidates: list[str] | None = None) -> str:
    """Where the drive is mounted now: the stored root if its content fits, else the best fit among the volumes.

    Each volume is tried itself and with what the stored root is called inside a
    volume. Without a fit, or without rows to compare, the stored root stays.
    """
    names, files = fingerprint(latest)
    if not (names or files) or (os.path.isdir(stored_root) and matches_root(stored_root, names, files)):
        return stored_root
    inside = paths_in_volume(stored_root)
    own = re.split(r"[/\\]", stored_root.rstrip("/\\"))[-1].lower()
    places = [os.path.join(c, s) if s else c for c in (mounted_volumes() if candidates is None else candidates) for s in ("", *inside)]
    scored = [(root_hits(p, names, files), os.path.basename(p).lower() == own, -i, p) for i, p in enumerate(places) if os.path.isdir(p)]
    best = max(scored, default=(0,))
    return best[-1] if best[0] else stored_root
