"""Results as CSV, JSON and XLSX files, and plans as scripts to review."""

from __future__ import annotations

import csv
import json
import logging
import shlex
from collections.abc import Iterable
from functools import partial
from itertools import groupby
from pathlib import PureWindowsPath

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# The columns of the duplicate export, in order.
EXPORT_COLUMNS = ("group_id", "hash", "size_bytes", "size_human", "group_count", "distinct_inodes", "wasted_bytes", "wasted_human", "path", "is_hardlink")


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def write_csv_file(df: DataFrame, file: str, encoding: str = "utf-8-sig") -> None:
    """A report as one file, which spreadsheets read as Unicode by its mark; rows come partition by partition."""
    with open(file, "w", encoding=encoding, newline="") as out:
        lines = csv.writer(out)
        lines.writerow(df.columns)
        lines.writerows(df.toLocalIterator())


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_xlsx(df: DataFrame, file: str, sheet: str = "Duplicates", limit: int = 1_000_000) -> None:
    """A sheet with a bold, frozen head; needs openpyxl. ``limit``: rows that a sheet can hold."""
    try:
        from openpyxl import Workbook
        from openpyxl.styles import Font, PatternFill
    except ImportError as e:
        raise RuntimeError("openpyxl isn't installed; write CSV instead") from e
    book = Workbook()
    page = book.active
    page.title = sheet
    page.append(df.columns)
    for cell in page[1]:
        cell.font, cell.fill = Font(bold=True), PatternFill("solid", fgColor="DDDDDD")
    page.freeze_panes = "A2"
    for i, row in enumerate(df.toLocalIterator()):
        if i >= limit:
            raise ValueError("more rows than a sheet can hold")
        page.append(list(row))
    book.save(file)


def append_audit(outcomes: DataFrame, folder: str) -> None:
    """Add the outcomes of actions to an audit log: a folder of JSON lines, with the time of writing.

    Earlier lines are never rewritten. A log that can't be written is warned of and
    doesn't undo what was done.
    """
    try:
        outcomes.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(folder)
    except Exception as e:
        logging.getLogger(__name__).warning("audit log %s not written: %s", folder, e)


def _literal(text: str, shell: str) -> str:
    """``text`` as one word that the shell takes as it stands."""
    if shell == "bash":
        return shlex.quote(text)
    return "'{}'".format(text.translate({ord("'"): "''"}))


def quarantine_name(group: int, copy: int, rel_path: str) -> str:
    return f"g{group:04d}_i{copy}__" + rel_path.replace("/", "__").replace(" ", "_")


def cleanup_script(plan: Iterable[Row], root: str, quarantine: str, action: str = "quarantine", shell: str = "bash") -> str:
    """A script that moves away (or deletes) the copies a cleanup plan doesn't keep.

    Every action checks that the file still has its size. Nothing is run here.
    ``plan``: rows of ``cleanup_plan`` for one drive. A PowerShell script begins with
    a byte order mark, without which older versions misread names beyond ASCII.
    """
    if action not in ("quarantine", "delete") or shell not in ("bash", "powershell"):
        raise ValueError("unknown action or shell")
    bash = shell == "bash"
    quote = partial(_literal, shell=shell)
    lines = ["#!/usr/bin/env bash", "set -euo pipefail"] if bash else ["\ufeff$ErrorActionPreference = 'Stop'"]
    if action == "quarantine":
        lines.append(f"mkdir -p -- {quote(quarantine)}" if bash else f"New-Item -ItemType Directory -Force -Path {quote(quarantine)} | Out-Null")
    for i, r in enumerate(sorted((r for r in plan if not r["keep"]), key=lambda r: (r["group_id"], r["rel_path"]))):
        path, to = f"{root}/{r['rel_path']}", f"{quarantine}/{quarantine_name(r['group_id'], i, r['rel_path'])}"
        lines.append(f"# group {r['group_id']}: kept {json.dumps(r['keeper'], ensure_ascii=False)}")
        if bash:
            step = f"mv -n -- {quote(path)} {quote(to)}" if action == "quarantine" else f"rm -- {quote(path)}"
            lines.append(f'[ "$(wc -c < {quote(path)})" -eq {r["size"]} ] && {step}')
        else:
            step = f"Move-Item -LiteralPath {quote(path)} -Destination {quote(to)}" if action == "quarantine" else f"Remove-Item -LiteralPath {quote(path)}"
            lines.append(f"if ((Get-Item -LiteralPath {quote(path)}).Length -eq {r['size']}) {{ {step} }}")
    return "\n".join(lines) + "\n"


def backup_script(items: Iterable[Row], roots: dict[int, str], target: str, tool: str = "rsync") -> str:
    """A script of rsync or robocopy that copies files held once, drive by drive. Drives without a root are named and left out."""
    if tool not in ("rsync", "robocopy"):
        raise ValueError(f"unknown tool: {tool}")
    by_drive: dict[int, list[str]] = {}
    for r in items:
        by_drive.setdefault(r["drive_id"], []).append(r["path"])
    lines = ["#!/usr/bin/env bash", "set -euo pipefail"] if tool == "rsync" else ["@echo off", "chcp 65001 > nul"]
    for drive, paths in sorted(by_drive.items()):
        if drive not in roots:
            lines.append(f"{'#' if tool == 'rsync' else 'REM'} drive {drive} isn't mounted: {len(paths)} files left out")
        elif tool == "rsync":
            listed = " ".join(map(shlex.quote, sorted(paths)))
            lines.append(f"printf '%s\\0' {listed} | rsync -a --from0 --files-from=- {shlex.quote(roots[drive] + '/')} {shlex.quote(f'{target}/drive_{drive}/')}")
        else:
            for folder, names in _by_folder(paths):
                at, to = PureWindowsPath(roots[drive], folder), PureWindowsPath(target, f"drive_{drive}", folder)
                # Percent signs would name variables.
                words = " ".join(f'"{w}"'.replace("%", "%%") for w in (at, to, *names))
                lines.append(f"robocopy {words} /COPY:DAT /R:1 /W:1")
    return "\n".join(lines) + "\n"


def _by_folder(paths: list[str]) -> Iterable[tuple[str, list[str]]]:
    split = sorted(p.rpartition("/")[::2] for p in paths)
    return [(folder, [name for _, name in group]) for folder, group in groupby(split, key=lambda x: x[0])]
