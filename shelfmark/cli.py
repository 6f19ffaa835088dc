"""Command line: the library's operators over a folder of tables."""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.inventory import load, read_inventory
from shelfmark.operators import cleanup, cross, diff, duplicates, folders, totals, upkeep
from shelfmark.operators.hierarchy import link_defects
from shelfmark.operators.reconcile import copy_differences
from shelfmark.operators.snapshot_changes import snapshot_changes
from shelfmark.plans.search import QueryError, search, search_total
from shelfmark.runtime import get_session, materialize
from shelfmark.sources import actions, exports, ingest, registry
from shelfmark.sources.filesystem import SYSTEM_DISK_FOLDERS
from shelfmark.sources.store import Store


def _tables(spark: SparkSession, a: argparse.Namespace, *names: str) -> list[DataFrame]:
    return read_inventory(spark, a.tables, *names)


def _now() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S")


def _index(mode: str):
    def run(spark: SparkSession, a: argparse.Namespace) -> str:
        store = Store(spark, a.tables)
        if a.label or store.drives().where(F.col("id") == a.drive).isEmpty():
            store.name_drive(a.drive, a.label or None, os.path.abspath(a.root))
        exclusions = [e for e in a.exclude.split(",") if e] + list(SYSTEM_DISK_FOLDERS) * a.skip_system
        how = {"full": a.full, "exclusions": exclusions, "skip_cloud": a.skip_cloud, "one_fs": a.one_fs}
        if mode == "snapshot" and not a.keep_all:
            n, gone = ingest.take(spark, store, a.root, a.drive, a.at or _now(), a.note or None, **how)
            return f"drive {a.drive}: snapshot {n}, dropped {gone}"
        return f"drive {a.drive}: snapshot {ingest.index(spark, store, a.root, a.drive, a.at or _now(), a.note or None, mode, **how)}"

    return run


def _prune(spark: SparkSession, a: argparse.Namespace) -> str:
    as_of = a.as_of or _now().replace("T", " ")
    return f"dropped snapshots {Store(spark, a.tables).prune(a.drive, as_of, a.keep_last, a.keep_monthly, a.force)}"


def _compact(spark: SparkSession, a: argparse.Namespace) -> str:
    store = Store(spark, a.tables)
    store.compact(a.drive, a.snapshot or store.latest_id(a.drive), a.files)
    return "rewritten"


def _plan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return cleanup.cleanup_plan(load(spark, a.tables).where(F.col("drive_id") == a.drive), a.strategy, a.min_size)


def _execute(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    done = actions.execute(_plan(spark, a), a.root, a.action, a.quarantine, dry_run=not a.yes)
    if a.yes:
        exports.append_audit(done, a.audit or f"{a.tables}/audit")
    return done


def _duplicate_folders(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    latest = load(spark, a.tables)
    rows = materialize(folders.linked_rows(latest, *_tables(spark, a, "entries_core", "paths")), "folder-links")
    groups = folders.duplicate_folders(folders.folder_hashes(rows).join(rows.select("id", "drive_id"), "id"))
    return groups.join(latest.select(F.col("id").alias("first_id"), "rel_path"), "first_id").select("drive_id", "n", "rel_path")


def _auto_tags(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.init:
        registry.write_tag_rules(a.rules)
    return folders.auto_tags(load(spark, a.tables), registry.tag_rules(a.rules or None))


def _two(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    latest = load(spark, a.tables)
    return latest.where(F.col("drive_id") == a.a), latest.where(F.col("drive_id") == a.b)


def _diff(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = load(spark, a.tables, latest_only=False)
    if a.old is None and a.new is None:
        return diff.snapshot_diff(*diff.last_two(rows))
    if a.old is None or a.new is None or a.old == a.new:
        raise SystemExit("give both of two different snapshots, or none")
    files = rows.where("is_dir = 0")
    return diff.snapshot_diff(files.where(F.col("snapshot_id") == a.old), files.where(F.col("snapshot_id") == a.new))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfmark", description=__doc__)
    p.add_argument("--tables", required=True, help="folder of a store, or with one Parquet table per name")
    p.add_argument("--out", help="write the whole result to this folder instead of showing its first rows")
    p.add_argument("--format", choices=("csv", "json", "parquet"), default="csv")
    p.add_argument("--rows", type=int, default=50, help="rows shown")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *positional: str, **options) -> None:
        """Options by their defaults: False is a flag, None a number without one, '' a text without one."""
        c = commands.add_parser(name)
        for argument in positional:
            c.add_argument(argument)
        for flag, default in options.items():
            kind = {"action": "store_true"} if default is False else {"type": int if default is None else type(default), "default": default}
            c.add_argument(f"--{flag.replace('_', '-')}", **kind)
        c.set_defaults(run=run)

    taking = {"drive": 1, "at": "", "note": "", "full": False, "exclude": "", "skip_system": False, "skip_cloud": False, "one_fs": False, "keep_all": False}
    for name, mode in (("index", "fresh"), ("snapshot", "snapshot"), ("refresh", "refresh")):
        add(name, _index(mode), "root", **taking, label="")
    add("fill", lambda s, a: f"hashed {ingest.fill(Store(s, a.tables), a.drive, a.root, a.min_size)}", "root", drive=1, min_size=1024)
    add("verify", lambda s, a: ingest.reread(s, Store(s, a.tables), a.drive, a.root), "root", drive=1)
    add("prune", _prune, drive=1, as_of="", keep_last=10, keep_monthly=12, force=False)
    add("compact", _compact, drive=1, snapshot=None, files=1)
    add("hash-versions", lambda s, a: registry.differing_hash_versions(*_tables(s, a, "drive", "copy_pairs")))
    add("drives", lambda s, a: _tables(s, a, "drive")[0])
    add("root", lambda s, a: registry.resolve_root(load(s, a.tables).where(F.col("drive_id") == a.drive), a.stored), "stored", drive=1)
    add("import-folder", lambda s, a: s.createDataFrame(registry.import_folder(a.folder), "file string, state string"), "folder")
    add("dup-folders", _duplicate_folders)
    cleaning = {"drive": 1, "strategy": "shortest", "min_size": 1 << 20}
    add("cleanup-script", lambda s, a: exports.cleanup_script(_plan(s, a).where("not keep").toLocalIterator(), a.root, a.quarantine, a.action, a.shell), "root", **cleaning, quarantine="quarantine", action="quarantine", shell="bash")
    add("execute", _execute, "root", **cleaning, quarantine="", action="quarantine", yes=False, audit="")
    add("find-total", lambda s, a: search_total(load(s, a.tables), a.query), "query")
    add("totals", lambda s, a: totals.drive_totals(load(s, a.tables)))
    add("snapshots", lambda s, a: totals.snapshot_list(*_tables(s, a, "snapshots")))
    add("ext-breakdown", lambda s, a: totals.extension_breakdown(load(s, a.tables), a.limit), limit=20)
    add("dup-groups", lambda s, a: duplicates.file_groups(load(s, a.tables), a.min_size), min_size=1024)
    add("export", lambda s, a: duplicates.duplicate_rows(load(s, a.tables), a.min_size).select(*exports.EXPORT_COLUMNS), min_size=1024)
    add("cross-dedupe", lambda s, a: cross.cross_groups(load(s, a.tables), a.min_size), min_size=1 << 20)
    add("single-copy", lambda s, a: cross.single_copies(load(s, a.tables), a.min_size), min_size=1 << 20)
    add("compare", lambda s, a: cross.compare_summary(*_two(s, a), a.min_size), a=1, b=2, min_size=1024)
    add("diff", _diff, old=None, new=None)
    add("changes", lambda s, a: snapshot_changes(*_tables(s, a, "entries_core", "snapshots")))
    add("copies", lambda s, a: copy_differences(*_tables(s, a, "entries_core", "snapshots", "drive", "copy_pairs")))
    add("retention", lambda s, a: diff.snapshot_retention(*_tables(s, a, "snapshots"), a.as_of, a.keep_last, a.keep_monthly), as_of="2024-01-01 00:00:00", keep_last=10, keep_monthly=12)
    add("cold", lambda s, a: folders.cold_folders(load(s, a.tables), a.before, a.min_size), before=1.5e9, min_size=100 << 20)
    add("treemap", lambda s, a: folders.treemap_rows(load(s, a.tables), a.min_size, a.files), min_size=100 << 20, files=False)
    add("auto-tags", _auto_tags, rules="", init=False)
    add("cleanup", lambda s, a: cleanup.cleanup_plan(load(s, a.tables), a.strategy, a.min_size), strategy="shortest", min_size=1 << 20)
    add("links", lambda s, a: link_defects(*_tables(s, a, "paths", "entries_core")))
    add("doctor", lambda s, a: upkeep.health_checks(*_tables(s, a, "drive", "snapshots", "paths", "entries_core")))
    find = commands.add_parser("find")
    find.add_argument("query", nargs="+")
    find.add_argument("--limit", type=int, default=200)
    find.set_defaults(run=lambda s, a: search(load(s, a.tables), " ".join(a.query), a.limit))
    tag = commands.add_parser("tags")
    tag.add_argument("text")
    tag.set_defaults(run=lambda s, a: upkeep.tag_search(*_tables(s, a, "folder_meta"), a.text))
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or get_session("shelfmark")
    try:
        df = a.run(spark, a)
        if isinstance(df, str):
            print(df)
            return 0
    except QueryError as e:
        print(f"query: {e}", file=sys.stderr)
        return 2
    if not a.out:
        df.show(a.rows, truncate=False)
    elif a.format == "csv":
        exports.write_csv(df, a.out)
    elif a.format == "json":
        exports.write_json(df, a.out)
    else:
        df.write.mode("overwrite").parquet(a.out)
    return int(a.command == "doctor" and not df.where("not ok").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
