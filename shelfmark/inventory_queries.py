"""Registered queries of the inventory operators, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.inventory import load
from shelfmark.operators import cleanup, cross, diff, duplicates, folders, totals, upkeep
from shelfmark.plans.search import search, search_total
from shelfmark.problem_queries import CURRENT, DELIVERED
from shelfmark.runtime import materialize
from shelfmark.tables import delivered_snapshots, read_table

MIN = 4096
COLD_BEFORE = 1_500_000_000
AS_OF = "2024-01-01 00:00:00"


def _latest(operator: Callable[..., DataFrame], *args, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(load(spark, folder), *args, **options)


def _pairs(operator: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``operator`` over all pairs of drives that should hold the same files."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        a, b = cross.paired(load(spark, folder), read_table(spark, folder, "copy_pairs"), read_table(spark, folder, "drive"))
        return operator(a, b, MIN, ["pair_id"])

    return query


def _diff(then: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: then(diff.snapshot_diff(*diff.last_two(load(spark, folder, latest_only=False))))


def _latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    d = delivered_snapshots(read_table(spark, folder, "entries_core"), read_table(spark, folder, "snapshots"))
    return d.where("is_latest").select("drive_id", "snapshot_id")


def _reuse(spark: SparkSession, folder: str) -> DataFrame:
    old, new = diff.last_two(load(spark, folder, latest_only=False))
    return upkeep.reuse_hashes(old, new).select("drive_id", "id", "from_id")


def _verify(spark: SparkSession, folder: str) -> DataFrame:
    old, new = diff.last_two(load(spark, folder, latest_only=False))
    return upkeep.verify(old, new)


def _merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of folders with equal contents inside the latest snapshot of a drive."""
    rows = materialize(folders.linked_rows(load(spark, folder), read_table(spark, folder, "entries_core"), read_table(spark, folder, "paths")), "folder-links")
    hashed = folders.folder_hashes(rows).join(rows.select("id", "drive_id"), "id")
    return folders.duplicate_folders(hashed).select("drive_id", F.lower(F.hex("hash")).alias("hash"), "n", "first_id")


def _retention(spark: SparkSession, folder: str) -> DataFrame:
    return diff.snapshot_retention(read_table(spark, folder, "snapshots"), AS_OF, 2, 6)


def _tag_search(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.tag_search(read_table(spark, folder, "folder_meta"), "lab")


def _health(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.health_checks(*[read_table(spark, folder, t) for t in ("drive", "snapshots", "paths", "entries_core")])


def _entry_counts(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.entry_counts(read_table(spark, folder, "snapshots"), read_table(spark, folder, "entries_core"))


def _search_totals(spark: SparkSession, folder: str) -> DataFrame:
    latest = load(spark, folder)
    return reduce(DataFrame.unionByName, [search_total(latest, q) for q in SEARCHES.values()])


def _single(then: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: then(cross.single_copies(load(spark, folder), MIN))


SEARCHES = {
    "search_glob_size": "*.mkv >1MB",
    "search_type_folder": "type:folder notas",
    "search_path_date": "path:backup modified:2018",
    "search_substring": "IMG_ size<100KB",
    "search_drive_label": 'drive:"Atlas-01" size>1KB',
    "search_dates_both": "modified>=2018-06 modified:2018",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "drive_totals": _latest(totals.drive_totals),
    "latest_snapshot": _latest_snapshot,
    "snapshot_list": lambda spark, folder: totals.snapshot_list(read_table(spark, folder, "snapshots")),
    "drive_info": lambda spark, folder: totals.drive_info(read_table(spark, folder, "drive"), read_table(spark, folder, "snapshots")),
    "human_sizes": _latest(totals.sizes_for_people),
    "ext_breakdown": _latest(totals.extension_breakdown),
    "dup_candidate_groups": _latest(duplicates.candidate_groups, MIN),
    "fill_candidates": _latest(duplicates.fill_candidates, MIN),
    "dup_confirmed_groups": _latest(duplicates.confirmed_groups, MIN),
    "dup_file_groups": _latest(duplicates.file_groups, MIN),
    "dup_rows_export": _latest(duplicates.duplicate_rows, MIN),
    "unconfirmed_backlog": _latest(duplicates.unconfirmed_backlog, MIN),
    "compare_matches": _pairs(cross.compare_matches),
    "compare_summary": _pairs(cross.compare_summary),
    "compare_only_in_a": _pairs(cross.only_in_a),
    "cross_dup_groups": _latest(cross.cross_groups, MIN),
    "cross_dup_copies": _latest(cross.cross_copies, MIN),
    "cross_overlap_matrix": _latest(cross.overlap_matrix, MIN),
    "single_copy_items": _single(lambda items: items),
    "single_copy_by_drive": _single(cross.single_copies_by_drive),
    "single_copy_by_folder": _single(cross.single_copies_by_folder),
    "diff_added": _diff(lambda d: d.where("change = 'added'")),
    "diff_removed": _diff(lambda d: d.where("change = 'removed'")),
    "diff_modified": _diff(lambda d: d.where("change = 'modified'")),
    "diff_summary": _diff(diff.diff_summary),
    "diff_top_growth": _diff(lambda d: diff.top_changes(d, "growth", 5)),
    "diff_top_shrink": _diff(lambda d: diff.top_changes(d, "shrink", 5)),
    "diff_top_count": _diff(lambda d: diff.top_changes(d, "count", 5)),
    "snapshot_retention": _retention,
    "folder_sizes": _latest(folders.folder_sizes),
    "treemap_rows": _latest(folders.treemap_rows, 1 << 24, files=True),
    "cold_folders": _latest(folders.cold_folders, COLD_BEFORE, 1 << 16),
    "auto_tags": _latest(folders.auto_tags),
    "merkle_dir_groups": _merkle,
    **{name: _latest(search, q) for name, q in SEARCHES.items()},
    "search_totals": _search_totals,
    **{f"cleanup_actions_{s}": _latest(cleanup.cleanup_plan, s, MIN) for s in cleanup.STRATEGIES},
    "cleanup_plan_groups": lambda spark, folder: cleanup.plan_groups(cleanup.cleanup_plan(load(spark, folder), "shortest", MIN)),
    "tag_search": _tag_search,
    "reuse_hits": _reuse,
    "verify_status": _verify,
    "doctor_checks": _health,
    "doctor_entry_counts": _entry_counts,
}

_E = f"""WITH {CURRENT}, {DELIVERED},
e AS (SELECT d.drive_id, dr.label AS drive, d.snapshot_id, d.idx, d.next_id IS NULL AS is_latest, c.id, c.parent_id, c.path_id,
             coalesce(p.full_path, '#' || c.path_id) AS rel_path, c.is_dir, c.size, c.mtime, c.partial_hash AS ph, c.full_hash AS fh,
             c.is_symlink, c.error, c.inode, c.device, c.inode IS NOT NULL AND c.device IS NOT NULL AS linked
      FROM cur c JOIN deliv d USING (snapshot_id) LEFT JOIN paths p ON p.id = c.path_id LEFT JOIN drive dr ON dr.id = d.drive_id),
l AS (SELECT * FROM e WHERE is_latest)"""

_HASHED = f"is_dir = 0 AND size >= {MIN} AND ph IS NOT NULL"


def _human(column: str) -> str:
    return f"""CASE WHEN coalesce({column}, 0) < 1024 THEN printf('%.1f B', coalesce({column}, 0)::DOUBLE)
 WHEN {column} / 1024.0 < 1024 THEN printf('%.1f KB', {column} / 1024.0) WHEN {column} / 1048576.0 < 1024 THEN printf('%.1f MB', {column} / 1048576.0)
 WHEN {column} / 1073741824.0 < 1024 THEN printf('%.1f GB', {column} / 1073741824.0)
 WHEN {column} / 1099511627776.0 < 1024 THEN printf('%.1f TB', {column} / 1099511627776.0) ELSE printf('%.1f PB', {column} / 1125899906842624.0) END"""


_PARENT = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
_NAME = "split_part(rel_path, '/', -1)"

_COPIES = f"""k AS (SELECT drive_id, size, ph, min(rel_path) AS rel_path, min_by(fh, (rel_path, id)) AS fh, min_by(id, (rel_path, id)) AS id, count(*) AS n_rows
  FROM l WHERE {_HASHED} GROUP BY drive_id, size, ph, CASE WHEN linked THEN concat_ws('/', inode, device) ELSE 'id' || id END)"""
_CROSS = f"""{_COPIES},
q AS (SELECT size, ph, count(DISTINCT drive_id) AS key_drives, count(*) - count(fh) > 0 AS open FROM k GROUP BY size, ph),
m AS (SELECT k.*, q.key_drives, q.open, CASE WHEN NOT q.open AND q.key_drives > 1 THEN k.fh END AS sub FROM k JOIN q USING (size, ph))"""
_SINGLE = f"""{_E}, {_CROSS},
items AS (SELECT min(drive_id) AS drive_id, min_by(rel_path, (length(rel_path), rel_path)) AS path, size, count(*) AS internal_copies
  FROM m WHERE key_drives = 1 OR NOT open GROUP BY size, ph, sub HAVING count(DISTINCT drive_id) = 1 AND (SELECT count(DISTINCT drive_id) FROM l) > 1)"""

_DIFF = f"""{_E},
mx AS (SELECT drive_id, max(idx) AS last_idx FROM e GROUP BY drive_id),
o AS (SELECT e.* FROM e JOIN mx USING (drive_id) WHERE idx = last_idx - 1 AND is_dir = 0),
n AS (SELECT e.* FROM e JOIN mx USING (drive_id) WHERE idx = last_idx AND last_idx > 1 AND is_dir = 0),
j AS (SELECT drive_id, path_id, coalesce(n.rel_path, o.rel_path) AS rel_path, o.size AS old_size, n.size AS new_size,
   CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.size <> n.size OR o.ph IS DISTINCT FROM n.ph THEN 'modified' END AS change
  FROM o FULL JOIN n USING (drive_id, path_id)),
gone AS (SELECT drive_id, nfc_normalize(rel_path) AS form, max_by(old_size, (rel_path, path_id)) AS gone_size, count(*) AS was FROM j WHERE change = 'removed' GROUP BY 1, 2),
ad AS (SELECT j.*, g.gone_size, g.was, g.form FROM j LEFT JOIN gone g ON g.drive_id = j.drive_id AND g.form = nfc_normalize(j.rel_path) WHERE j.change = 'added'),
diffs AS (
  SELECT drive_id, change, rel_path, old_size, new_size FROM j WHERE change = 'modified'
  UNION ALL SELECT drive_id, change, rel_path, old_size, new_size FROM ad WHERE was IS NULL
  UNION ALL SELECT drive_id, 'modified', rel_path, gone_size, new_size FROM ad WHERE was IS NOT NULL AND coalesce(gone_size, 0) <> coalesce(new_size, 0)
  UNION ALL SELECT drive_id, change, rel_path, old_size, new_size FROM j WHERE change = 'removed' AND (drive_id, nfc_normalize(rel_path)) NOT IN (SELECT (drive_id, form) FROM ad WHERE was IS NOT NULL))"""
_DELTA = "coalesce(new_size, 0) - coalesce(old_size, 0)"
_TOP = f"""{_DIFF},
t AS (SELECT drive_id, CASE WHEN len(string_split(rel_path, '/')) > 2 THEN array_to_string(string_split(rel_path, '/')[1:2], '/') ELSE split_part(rel_path, '/', 1) END AS folder,
   CAST(sum({_DELTA}) AS BIGINT) AS growth, CAST(sum(CASE change WHEN 'added' THEN 1 WHEN 'removed' THEN -1 ELSE 0 END) AS BIGINT) AS files FROM diffs GROUP BY 1, 2)
SELECT drive_id, folder, growth, files, CAST(row_number() OVER (PARTITION BY drive_id ORDER BY {{}}, folder) AS INTEGER) AS rank FROM t QUALIFY rank <= 5"""

_ANCESTORS = """list_concat(['.'], list_transform(range(1, len(string_split({0}, '/'))), lambda i: array_to_string(string_split({0}, '/')[1:i], '/')))"""
_FOLDERS = f"""{_E}, f AS (SELECT drive_id, rel_path, size, mtime, error, unnest({_ANCESTORS.format("rel_path")}) AS folder FROM l WHERE is_dir = 0)"""

_RULES = ", ".join(f"({i}, '{tag}', '{ext}')" for i, (tag, exts) in enumerate(folders.TAG_RULES.items()) for ext in exts)
_COMPOUND = "|".join(e.replace(".", "\\.") for e in sorted({e for exts in folders.TAG_RULES.values() for e in exts if "." in e}, key=lambda e: -len(e)))

def _search(name: str) -> str:
    return f"""{_E} SELECT drive_id, drive, id, rel_path, is_dir, coalesce(size, 0) AS size, mtime FROM l WHERE {_HITS[name]}
ORDER BY coalesce(size, 0) DESC, drive NULLS FIRST, drive_id, rel_path, id LIMIT 500"""


def _totals() -> str:
    parts = (f"SELECT '{SEARCHES[name]}' AS query, count(*) AS total, count(*) > 500 AS truncated FROM l WHERE {hit}" for name, hit in _HITS.items())
    return f"{_E} " + "\nUNION ALL ".join(parts)


_HITS = {
    "search_glob_size": f"size >= 1048577 AND regexp_full_match(lower({_NAME}), '.*\\.mkv', 's')",
    "search_type_folder": f"is_dir = 1 AND contains(lower({_NAME}), 'notas')",
    "search_path_date": "contains(lower(rel_path), 'backup') AND mtime >= epoch(TIMESTAMP '2018-01-01') AND mtime <= epoch(TIMESTAMP '2019-01-01')",
    "search_substring": f"size <= 102399 AND contains(lower({_NAME}), 'img_')",
    "search_drive_label": "lower(drive) = 'atlas-01' AND size >= 1025",
    "search_dates_both": "mtime >= epoch(TIMESTAMP '2018-06-01') AND mtime <= epoch(TIMESTAMP '2019-01-01')",
}


_PLAN = f"""{_E},
g AS (SELECT drive_id, fh, row_number() OVER (PARTITION BY drive_id ORDER BY fh) AS group_id FROM l WHERE is_dir = 0 AND fh IS NOT NULL AND size >= {MIN} GROUP BY drive_id, fh HAVING count(*) > 1),
c AS (SELECT drive_id, fh, min(rel_path) AS rel_path, min_by(id, (rel_path, id)) AS id, min_by(struct_pack(v := size), (rel_path, id)).v AS size,
   min_by(struct_pack(v := mtime), (rel_path, id)).v AS mtime, count(*) - 1 AS hardlinks
  FROM l WHERE is_dir = 0 AND fh IS NOT NULL AND size >= {MIN} GROUP BY drive_id, fh, inode, coalesce(device, -1), CASE WHEN inode IS NULL THEN rel_path END),
w AS (SELECT c.*, count(*) OVER (PARTITION BY drive_id, fh) AS n_copies, first_value(rel_path) OVER o AS keeper, first_value(id) OVER o AS keep_id
  FROM c WINDOW o AS (PARTITION BY drive_id, fh ORDER BY {{}} rel_path, id)),
pl AS (SELECT drive_id, group_id, lower(hex(fh)) AS hash, id, rel_path, size, mtime, hardlinks, n_copies, keeper, id = keep_id AS keep FROM w JOIN g USING (drive_id, fh) WHERE n_copies > 1)"""
_FIRST = {
    "shortest": "length(rel_path),",
    "oldest": "CASE WHEN mtime IS NULL OR mtime = 0 THEN 'inf'::DOUBLE ELSE mtime END,",
    "newest": "-CASE WHEN mtime IS NULL OR mtime = 0 THEN 0 ELSE mtime END,",
    "alphabetical": "",
}
_MATCH = f"""{_E}, dl AS (SELECT label, min(id) AS id FROM drive WHERE label IS NOT NULL GROUP BY label),
pr AS (SELECT pair_id, da.id AS a, db.id AS b FROM copy_pairs JOIN dl da ON da.label = label_a JOIN dl db ON db.label = label_b),
fa AS (SELECT pr.pair_id, l.* FROM l JOIN pr ON pr.a = l.drive_id WHERE {_HASHED}),
fb AS (SELECT pr.pair_id, l.* FROM l JOIN pr ON pr.b = l.drive_id WHERE {_HASHED}),
x AS (SELECT fa.pair_id, fa.id, fa.rel_path, fa.size, count(fb.id) AS n_all,
   count(fb.id) FILTER (fa.fh IS NULL OR fb.fh IS NULL OR fa.fh = fb.fh) AS n_in_b, count(fb.id) FILTER (fa.fh = fb.fh) AS n_same,
   count(fb.id) FILTER (fa.fh = fb.fh) > 0 AS confirmed,
   coalesce(min(fb.rel_path) FILTER (fa.fh = fb.fh), min(fb.rel_path) FILTER (fa.fh IS NULL OR fb.fh IS NULL)) AS first_in_b
  FROM fa LEFT JOIN fb ON fb.pair_id = fa.pair_id AND fb.size = fa.size AND fb.ph = fa.ph GROUP BY ALL)"""

SQL = {
    "drive_totals": f"""{_E} SELECT drive_id, snapshot_id, count(*) FILTER (is_dir = 0 AND coalesce(is_symlink, 0) = 0 AND error IS NULL) AS total_files,
 count(*) FILTER (is_dir = 1) AS total_dirs, CAST(coalesce(sum(size) FILTER (is_dir = 0 AND coalesce(is_symlink, 0) = 0 AND error IS NULL), 0) AS BIGINT) AS total_size FROM l GROUP BY drive_id, snapshot_id""",
    "doctor_entry_counts": f"""WITH {CURRENT}, n AS (SELECT snapshot_id AS id, count(*) FILTER (is_dir = 0 AND coalesce(is_symlink, 0) = 0) AS f, count(*) FILTER (is_dir = 1) AS d, count(*) AS n FROM cur GROUP BY snapshot_id),
 x AS (SELECT s.*, coalesce(n.f, 0) AS f, coalesce(n.d, 0) AS d, coalesce(n.n, 0) AS n FROM snapshots s LEFT JOIN n USING (id))
 SELECT drive_id, id AS snapshot_id, (coalesce(total_files, 0) <= 0 OR abs(f - total_files) * 20 <= total_files) AND (total_dirs IS NULL OR abs(d - total_dirs) <= 1)
   AND NOT (n = 0 AND (coalesce(total_files, 0) > 0 OR coalesce(total_dirs, 0) > 0)) AS ok, total_files, f AS n_files, total_dirs, d AS n_dirs FROM x""",
    "drive_info": """WITH s AS (SELECT drive_id, count(*) AS n, max_by(taken_at, (taken_at, id)) AS last_taken_at, arg_max_null(label, (taken_at, id)) AS last_label FROM snapshots GROUP BY drive_id)
 SELECT id AS drive_id, d.label, root_path, indexed_at, hash_version, total_files, total_dirs, total_size, coalesce(s.n, 0) AS n_snapshots, last_taken_at, last_label FROM drive d LEFT JOIN s ON s.drive_id = d.id""",
    "latest_snapshot": f"WITH {DELIVERED} SELECT drive_id, snapshot_id FROM deliv WHERE next_id IS NULL",
    "snapshot_list": "SELECT drive_id, id AS snapshot_id, taken_at, label FROM snapshots",
    "human_sizes": f"{_E} SELECT id, {_human('size')} AS size_human FROM l WHERE is_dir = 0",
    "ext_breakdown": f"""{_E}, x AS (SELECT CASE WHEN contains({_NAME}, '.') THEN lower(regexp_replace({_NAME}, '^[^.]*\\.', '')) ELSE '(no ext)' END AS ext, size FROM l WHERE is_dir = 0),
 y AS (SELECT ext, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS size_bytes FROM x GROUP BY ext)
 SELECT *, {_human('size_bytes')} AS size_human FROM y ORDER BY size_bytes DESC, ext LIMIT 20""",
    "dup_candidate_groups": f"{_E} SELECT drive_id, size, lower(hex(ph)) AS partial, count(*) AS n FROM l WHERE {_HASHED} AND error IS NULL GROUP BY drive_id, size, ph HAVING count(*) > 1",
    "fill_candidates": f"""{_E} SELECT drive_id, id, rel_path, size FROM (SELECT *, count(*) OVER (PARTITION BY drive_id, size, ph) AS n FROM l WHERE {_HASHED} AND error IS NULL) WHERE n > 1 AND fh IS NULL""",
    "dup_confirmed_groups": f"""{_E}, g AS (SELECT drive_id, fh, count(*) AS n, min(size) AS size, CAST(sum(size) AS BIGINT) AS total, count(DISTINCT CASE WHEN linked THEN concat_ws('/', inode, device) END) AS i
  FROM l WHERE is_dir = 0 AND fh IS NOT NULL AND size >= {MIN} GROUP BY drive_id, fh HAVING count(*) > 1)
 SELECT drive_id, lower(hex(fh)) AS hash, n, size, total, CASE WHEN i > 0 THEN i ELSE n END AS distinct_copies, n - CASE WHEN i > 0 THEN i ELSE n END AS hardlinks, size * (CASE WHEN i > 0 THEN i ELSE n END - 1) AS wasted FROM g""",
    "dup_file_groups": f"""{_E}, {_COPIES},
 q AS (SELECT drive_id, size, ph, count(*) AS n, count(fh) AS known, CAST(sum(n_rows) - count(*) AS BIGINT) AS hardlinks FROM k GROUP BY drive_id, size, ph)
 SELECT drive_id, lower(hex(fh)) AS hash, true AS confirmed, size, count(*) AS n, any_value(hardlinks) AS hardlinks, size * (count(*) - 1) AS wasted FROM k JOIN q USING (drive_id, size, ph) WHERE q.known = q.n GROUP BY drive_id, size, ph, fh HAVING count(*) > 1
 UNION ALL SELECT drive_id, lower(hex(ph)), false, size, n, hardlinks, size * (n - 1) FROM q WHERE known < n AND n > 1""",
    "dup_rows_export": f"""{_E}, f AS (SELECT * FROM l WHERE is_dir = 0 AND fh IS NOT NULL AND size >= {MIN}),
 g AS (SELECT drive_id, fh, count(*) AS group_count, count(DISTINCT CASE WHEN linked THEN concat_ws('/', inode, device) END) AS i, row_number() OVER (PARTITION BY drive_id ORDER BY fh) AS group_id FROM f GROUP BY drive_id, fh HAVING count(*) > 1),
 x AS (SELECT f.*, g.group_id, g.group_count, CASE WHEN i > 0 THEN i ELSE group_count END AS distinct_inodes, size * (CASE WHEN i > 0 THEN i ELSE group_count END - 1) AS wasted_bytes,
   row_number() OVER (PARTITION BY drive_id, fh, inode, coalesce(device, -1) ORDER BY rel_path, id) AS seen FROM f JOIN g USING (drive_id, fh))
 SELECT drive_id, group_id, lower(hex(fh)) AS hash, size AS size_bytes, {_human('size')} AS size_human, group_count, distinct_inodes, wasted_bytes, {_human('wasted_bytes')} AS wasted_human, rel_path AS path, inode IS NOT NULL AND seen > 1 AS is_hardlink FROM x""",
    "unconfirmed_backlog": f"""{_E}, g AS (SELECT drive_id, size, count(*) AS n FROM l WHERE {_HASHED} AND fh IS NULL GROUP BY drive_id, size, ph HAVING count(*) > 1)
 SELECT drive_id, count(*) AS n_groups, CAST(sum(size * (n - 1)) AS BIGINT) AS bytes FROM g GROUP BY drive_id""",
    "compare_matches": f"{_MATCH} SELECT pair_id, id, rel_path, size, n_in_b, first_in_b, confirmed FROM x WHERE n_in_b > 0",
    "compare_summary": f"""{_MATCH} SELECT pair_id, count(*) FILTER (n_in_b > 0) AS matched_files, CAST(coalesce(sum(size) FILTER (n_in_b > 0), 0) AS BIGINT) AS matched_bytes, count(*) FILTER (n_in_b > 0 AND confirmed) AS confirmed_files,
 count(*) FILTER (n_all = 0) AS only_in_a, CAST(coalesce(sum(size) FILTER (n_all = 0), 0) AS BIGINT) AS only_in_a_bytes,
 CAST(sum(n_in_b) AS BIGINT) AS pairs, CAST(sum(n_in_b * size) AS BIGINT) AS pair_bytes, CAST(sum(n_same) AS BIGINT) AS confirmed_pairs FROM x GROUP BY pair_id""",
    "compare_only_in_a": f"{_MATCH} SELECT pair_id, id, rel_path, size FROM x WHERE n_all = 0",
    "cross_dup_groups": f"""{_E}, {_CROSS}, pd AS (SELECT size, ph, open, sub, drive_id, count(*) AS n FROM m WHERE key_drives > 1 GROUP BY ALL)
 SELECT size, lower(hex(ph)) AS partial, lower(hex(sub)) AS "full", NOT open AS confirmed, count(*) AS n_drives, CAST(sum(n) AS BIGINT) AS n_copies, count(*) FILTER (n > 1) AS n_intra,
  string_agg(drive_id::VARCHAR, '|' ORDER BY drive_id) AS drives, CAST(size * (sum(n) - 1) AS BIGINT) AS wasted_bytes FROM pd GROUP BY size, ph, open, sub HAVING count(*) > 1""",
    "cross_dup_copies": f"""{_E}, {_CROSS} SELECT size, lower(hex(ph)) AS partial, lower(hex(sub)) AS "full", drive_id, rel_path, id
 FROM (SELECT *, min(drive_id) OVER w <> max(drive_id) OVER w AS wide FROM m WHERE key_drives > 1 WINDOW w AS (PARTITION BY size, ph, sub)) WHERE wide""",
    "cross_overlap_matrix": f"""{_E}, {_CROSS}, s AS (SELECT DISTINCT size, ph, sub, drive_id FROM m WHERE key_drives > 1)
 SELECT a.drive_id AS drive_a, b.drive_id AS drive_b, CAST(sum(a.size) AS BIGINT) AS bytes FROM s a JOIN s b ON a.size = b.size AND a.ph = b.ph AND a.sub IS NOT DISTINCT FROM b.sub AND a.drive_id <> b.drive_id GROUP BY 1, 2""",
    "single_copy_items": f"{_SINGLE} SELECT * FROM items",
    "single_copy_by_drive": f"{_SINGLE} SELECT drive_id, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM items GROUP BY drive_id",
    "single_copy_by_folder": f"""{_SINGLE} SELECT drive_id, {_PARENT.format('path')} AS folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM items GROUP BY 1, 2 ORDER BY bytes DESC, drive_id, folder LIMIT 40""",
    **{f"diff_{c}": f"{_DIFF} SELECT drive_id, change, rel_path, old_size, new_size FROM diffs WHERE change = '{c}'" for c in ("added", "removed", "modified")},
    "diff_summary": f"""{_DIFF} SELECT drive_id, count(*) FILTER (change = 'added') AS added_count, CAST(coalesce(sum({_DELTA}) FILTER (change = 'added'), 0) AS BIGINT) AS added_bytes,
 count(*) FILTER (change = 'removed') AS removed_count, CAST(coalesce(sum(-({_DELTA})) FILTER (change = 'removed'), 0) AS BIGINT) AS removed_bytes,
 count(*) FILTER (change = 'modified') AS modified_count, CAST(coalesce(sum({_DELTA}) FILTER (change = 'modified'), 0) AS BIGINT) AS modified_delta_bytes FROM diffs GROUP BY drive_id""",
    "diff_top_growth": _TOP.format("growth DESC"),
    "diff_top_shrink": _TOP.format("growth"),
    "diff_top_count": _TOP.format("files DESC"),
    "snapshot_retention": f"""WITH s AS (SELECT drive_id, id, taken_at, strptime(taken_at, '%Y-%m-%dT%H:%M:%S') AS ts, row_number() OVER (PARTITION BY drive_id ORDER BY taken_at DESC, id DESC) AS r FROM snapshots),
 o AS (SELECT *, r > 2 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 186 DAY AS old FROM s)
 SELECT drive_id, id AS snapshot_id, r <= 2 OR (old AND row_number() OVER (PARTITION BY drive_id, old, date_trunc('month', ts) ORDER BY taken_at DESC, id DESC) = 1) AS keep FROM o""",
    "folder_sizes": f"{_FOLDERS} SELECT drive_id, folder, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) AS n_files FROM f GROUP BY drive_id, folder",
    "treemap_rows": f"""{_FOLDERS}, s AS (SELECT drive_id, folder, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM f GROUP BY drive_id, folder HAVING coalesce(sum(size), 0) >= {1 << 24}),
 u AS (SELECT drive_id, folder AS node, CASE WHEN folder = '.' THEN '' ELSE {_PARENT.format('folder')} END AS parent, CASE WHEN folder = '.' THEN '/' ELSE split_part(folder, '/', -1) || '/' END AS name, bytes AS size, 'dir' AS kind FROM s
  UNION ALL SELECT drive_id, rel_path, {_PARENT.format('rel_path')}, {_NAME}, size, 'file' FROM l WHERE is_dir = 0 AND size >= {1 << 24})
 SELECT *, {_human('size')} AS size_human FROM u""",
    "cold_folders": f"""{_FOLDERS}, c AS (SELECT drive_id, folder, CAST(coalesce(sum(size), 0) AS BIGINT) AS size, max(mtime) AS newest_mtime, count(*) AS file_count FROM f
  WHERE error IS NULL AND mtime IS NOT NULL GROUP BY drive_id, folder HAVING max(mtime) < {COLD_BEFORE} AND folder <> '.')
 SELECT * FROM c WHERE size >= {1 << 16} AND (drive_id, {_PARENT.format('folder')}) NOT IN (SELECT (drive_id, folder) FROM c)""",
    "auto_tags": f"""{_E}, rules(rule, tag, ext) AS (VALUES {_RULES}),
 x AS (SELECT DISTINCT drive_id, {_PARENT.format('rel_path')} AS folder, CASE WHEN regexp_matches(lower({_NAME}), '\\.({_COMPOUND})$') THEN regexp_extract(lower({_NAME}), '\\.({_COMPOUND})$', 1)
   WHEN contains({_NAME}, '.') THEN lower(split_part({_NAME}, '.', -1)) ELSE '' END AS ext FROM l WHERE is_dir = 0 AND error IS NULL),
 t AS (SELECT DISTINCT drive_id, folder, rule, tag FROM x JOIN rules USING (ext))
 SELECT drive_id, folder, string_agg(tag, '|' ORDER BY rule) AS tags FROM t GROUP BY drive_id, folder""",
    **{name: _search(name) for name in SEARCHES},
    "search_totals": _totals(),
    **{f"cleanup_actions_{s}": _PLAN.format(by) + " SELECT * FROM pl" for s, by in _FIRST.items()},
    "cleanup_plan_groups": _PLAN.format(_FIRST["shortest"])
    + " SELECT drive_id, group_id, hash, keeper, max(n_copies) AS n_copies, count(*) FILTER (NOT keep) AS n_actions, CAST(coalesce(sum(size) FILTER (NOT keep), 0) AS BIGINT) AS freeable, CAST(sum(hardlinks) AS BIGINT) AS n_hardlinks FROM pl GROUP BY ALL",
    "tag_search": """WITH t AS (SELECT drive_id, rel_path, CASE WHEN json_valid(tags) THEN from_json(tags, '["VARCHAR"]') ELSE [] END AS g, note FROM folder_meta)
 SELECT drive_id, rel_path, array_to_string(g, '|') AS tags, note FROM t WHERE len(list_filter(g, lambda x: contains(lower(x), 'lab'))) > 0 OR contains(lower(rel_path), 'lab') OR contains(lower(coalesce(note, '')), 'lab')""",
    "reuse_hits": f"""{_DIFF}, u AS (SELECT drive_id, nfc_normalize(rel_path) AS form, min_by(struct_pack(id := id, size := size, mtime := mtime), (rel_path, id)) AS c FROM o
  WHERE error IS NULL AND coalesce(is_symlink, 0) = 0 AND ph IS NOT NULL AND size IS NOT NULL AND mtime IS NOT NULL GROUP BY 1, 2),
 z AS (SELECT n.drive_id, n.id, u.c.id AS from_id, abs(n.mtime - u.c.mtime) AS d FROM n JOIN u ON u.drive_id = n.drive_id AND u.form = nfc_normalize(n.rel_path) AND u.c.size = n.size WHERE coalesce(n.is_symlink, 0) = 0)
 SELECT drive_id, id, from_id FROM z WHERE CASE WHEN d <= 2 THEN true WHEN d > 93602 THEN false ELSE d % 3600 <= 2 OR d % 3600 >= 3598 END""",
    "verify_status": f"""{_DIFF} SELECT o.drive_id, CASE WHEN n.id IS NULL THEN 'missing' WHEN n.error IS NOT NULL OR n.ph IS NULL THEN 'unreadable' WHEN o.size IS DISTINCT FROM n.size THEN 'size_changed' WHEN o.ph <> n.ph THEN 'corrupted' ELSE 'ok' END AS status, count(*) AS n
 FROM o LEFT JOIN n ON n.drive_id = o.drive_id AND n.path_id = o.path_id WHERE o.error IS NULL AND coalesce(o.is_symlink, 0) = 0 AND o.ph IS NOT NULL GROUP BY 1, 2""",
    "doctor_checks": """WITH f AS (SELECT * FROM entries_core WHERE is_dir = 0 AND error IS NULL AND coalesce(is_symlink, 0) = 0),
 c(name, n_bad, allowed) AS (
  SELECT 'hash_version', count(*), 0 FROM drive WHERE hash_version IS DISTINCT FROM 2 UNION ALL SELECT 'labels', count(*), 0 FROM drive WHERE label IS NULL
  UNION ALL SELECT 'snapshot_times', count(*), 0 FROM snapshots WHERE try_strptime(taken_at, '%Y-%m-%dT%H:%M:%S') IS NULL
  UNION ALL SELECT 'orphan_paths', count(*), 0 FROM entries_core e WHERE path_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM paths p WHERE p.id = e.path_id)
  UNION ALL SELECT 'unlisted_snapshots', count(*), 0 FROM entries_core e WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.id = e.snapshot_id)
  UNION ALL SELECT 'file_sizes', count(*), 0 FROM f WHERE size IS NULL
  UNION ALL SELECT 'hash_coverage', count(*) FILTER (partial_hash IS NULL), count(*) / 20.0 FROM f WHERE size IS NOT NULL)
 SELECT name, n_bad <= allowed AS ok, n_bad FROM c""",
}
# Folder hashes take a round per level, which SQL can't express; they are tested against a plain model.
