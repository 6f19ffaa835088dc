"""Column expressions on paths, sizes and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """The folder of a path; '.' for a path without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """'.' and every proper folder prefix of a path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    inner = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    return F.concat(F.array(F.lit(".")), F.coalesce(inner, F.array().cast("array<string>")))


def first_dot_extension(path: Column) -> Column:
    """What follows the first dot of the name, in lower case; '(no ext)' without a dot."""
    name = base_name(path)
    return F.when(F.instr(name, ".") > 0, F.lower(F.regexp_replace(name, "^[^.]*\\.", ""))).otherwise(F.lit("(no ext)"))


def tag_extension(path: Column, compounds: Sequence[str]) -> Column:
    """The longest compound extension that fits, else what follows the last dot, else ''."""
    name = F.lower(base_name(path))
    out = None
    for c in sorted(compounds, key=lambda c: (-c.count("."), -len(c), c)):
        hit = name.endswith("." + c)
        out = F.when(hit, F.lit(c)) if out is None else out.when(hit, F.lit(c))
    last = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))
    return last if out is None else out.otherwise(last)


def top_folder(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` parts of a path with more of them, else its first part."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")).otherwise(parts[0])


def human_size(n: Column) -> Column:
    """A size in binary units with one decimal; 0 for null."""
    value = F.coalesce(n, F.lit(0)).cast("double")
    out = None
    for i, unit in enumerate(UNITS):
        text = F.concat(F.regexp_replace(F.call_function("format_number", value / F.lit(float(1024**i)), F.lit("0.0")), ",", ""), F.lit(f" {unit}"))
        if i == len(UNITS) - 1:
            return out.otherwise(text)
        fits = value / float(1024**i) < 1024
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out


def same_mtime(a: Column, b: Column) -> Column:
    """Whether two times are the same but for 2 seconds and a whole-hour shift of up to 26 hours."""
    d = F.abs(a - b)
    hour = d % 3600
    return F.when(d <= 2, True).when(d > 26 * 3600 + 2, False).otherwise((hour <= 2) | (hour >= 3598))


def physical_copy(inode: Column, device: Column, own: Column) -> Column:
    """What identifies a file's storage: (inode, device), or the row itself where one is null."""
    linked = inode.isNotNull() & device.isNotNull()
    return F.struct(F.when(linked, inode).alias("inode"), F.when(linked, device).alias("device"), F.when(~linked, own).alias("own"))
