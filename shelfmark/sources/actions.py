"""Carrying out cleanup plans on the executors, with every check made again at the file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import map_arrow, materialize
from shelfmark.sources.exports import quarantine_name

ACTIONS = ("quarantine", "delete")

#: Outcomes: 'would_do' in a dry run, 'done', 'gone' (carried out before), or why a file was left alone.
_OUTCOME = "group_id long, rel_path string, size long, action string, outcome string"


def _inside(root: str, path: str) -> bool:
    """Whether a path names something below the root, without following the last link."""
    folder = os.path.realpath(os.path.join(root, os.path.dirname(path)))
    top = os.path.realpath(root)
    return os.path.basename(path) not in ("", ".", "..") and os.path.commonpath([folder, top]) == top


def _size(path: str) -> int | None:
    """Size of a regular file; None for anything else."""
    try:
        return os.lstat(path).st_size if os.path.isfile(path) and not os.path.islink(path) else None
    except OSError:
        return None


def _act(root: str, path: str, size: int, keeper: str, to: str | None, dry_run: bool) -> str:
    if not (_inside(root, path) and _inside(root, keeper)):
        return "outside_root"
    at = os.path.join(root, path)
    if _size(os.path.join(root, keeper)) != size:
        return "no_keeper"
    if not os.path.lexists(at):
        return "gone" if to is None or os.path.lexists(to) else "missing"
    if _size(at) != size:
        return "size_changed"
    if to is not None and os.path.lexists(to):
        return "name_taken"
    if dry_run:
        return "would_do"
    try:
        os.remove(at) if to is None else os.rename(at, to)
    except OSError as e:
        return f"failed: {e.strerror}"
    return "done"


def execute(plan: DataFrame, root: str, action: str = "quarantine", quarantine: str | None = None, dry_run: bool = True) -> DataFrame:
    """(group_id, rel_path, size, action, outcome) of every copy that the plan doesn't keep.

    ``plan``: rows of ``cleanup_plan`` for one drive, whose ``root`` the executors
    see. Nothing is touched in a dry run, which is the default. A copy goes only
    where it still has its size, lies below the root, and the copy that is kept is
    there with the same size. Files are renamed into the quarantine folder, which must
    be on the same file system. A repeated task finds a file gone and says so. The
    outcomes are written before they are returned, so each action is taken once.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    if not os.path.isdir(root):
        raise ValueError(f"not mounted: {root}")
    away = os.path.abspath(quarantine or os.path.join(root, ".quarantine")) if action == "quarantine" else None
    if away and not dry_run:
        os.makedirs(away, exist_ok=True)
    todo = plan.where("not keep").select("group_id", "id", "rel_path", "size", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for group, number, path, size, keeper in zip(*(batch[c].to_pylist() for c in ("group_id", "id", "rel_path", "size", "keeper"))):
                to = os.path.join(away, quarantine_name(group, number, path)) if away else None
                said.append(_act(root, path, size, keeper, to, dry_run))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch["group_id"], batch["rel_path"], batch["size"], pa.array([action] * n, pa.string()), pa.array(said, pa.string())], names=["group_id", "rel_path", "size", "action", "outcome"])

    typed = todo.select(F.col("group_id").cast("long").alias("group_id"), "id", "rel_path", F.col("size").cast("long").alias("size"), "keeper")
    return materialize(map_arrow(typed, run, _OUTCOME), "outcomes")
