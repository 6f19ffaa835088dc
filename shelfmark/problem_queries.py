"""Registered queries of the reconciliation and hierarchy operators, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.hierarchy import build_hierarchy, descendants, link_defects
from shelfmark.operators.hot_keys import content_key_totals, heavy_content_keys, running_totals
from shelfmark.operators.reconcile import copy_differences
from shelfmark.operators.snapshot_changes import snapshot_changes
from shelfmark.tables import read_table


def _tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, folder, n) for n in names]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(*_tables(spark, folder, "entries_core", "snapshots"))


def p1_per_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return p1_found(spark, folder).groupBy("snapshot_id", "change").agg(F.count(F.lit(1)).alias("n_files"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return copy_differences(*_tables(spark, folder, "entries_core", "snapshots", "drive", "copy_pairs"))


def _hex_keys(keys: DataFrame) -> DataFrame:
    """Content keys with the hash as text, as results give it."""
    return keys.withColumn("partial_hash", F.lower(F.hex("partial_hash")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _hex_keys(heavy_content_keys(*_tables(spark, folder, "entries_core")))


def p4_key_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _hex_keys(content_key_totals(*_tables(spark, folder, "entries_core")))


def p4_running(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each key so far, in order of loading: what a per-key window gives, without its imbalance."""
    (entries,) = _tables(spark, folder, "entries_core")
    files = entries.where("is_dir = 0 and partial_hash is not null").select("id", "size", "partial_hash", "loaded_at")
    return running_totals(files, ["size", "partial_hash"], ["loaded_at", "id"], "size").select("id", "key_row", "running")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return link_defects(*_tables(spark, folder, "paths", "entries_core"))


def p6_path_tree(spark: SparkSession, folder: str) -> DataFrame:
    (paths,) = _tables(spark, folder, "paths")
    tree = build_hierarchy(paths, "id", "parent_id", "segment").where("state = 'sound'")
    return tree.select(F.col("id").alias("node_id"), F.col("path").alias("built_path"), "depth", "root", F.col("below_n").alias("n_descendants"))


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    (paths,) = _tables(spark, folder, "paths")
    return descendants(build_hierarchy(paths, "id", "parent_id", "segment", chains=True))


CURRENT = """cur AS (
  SELECT * FROM entries_core WHERE snapshot_id IS NOT NULL AND path_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, path_id ORDER BY loaded_at DESC NULLS LAST, id DESC) = 1)"""

DELIVERED = """deliv AS (
  SELECT s.id AS snapshot_id, s.drive_id,
         row_number() OVER (PARTITION BY s.drive_id ORDER BY s.taken_at, s.id) AS idx,
         lead(s.id) OVER (PARTITION BY s.drive_id ORDER BY s.taken_at, s.id) AS next_id,
         epoch(strptime(s.taken_at, '%Y-%m-%dT%H:%M:%S')) AS taken_s
  FROM snapshots s WHERE s.id IN (SELECT snapshot_id FROM entries_core))"""

_P1 = f"""WITH {CURRENT}, {DELIVERED},
f AS (SELECT d.drive_id, d.snapshot_id, d.next_id, d.idx, c.path_id, c.size, c.partial_hash
      FROM cur c JOIN deliv d USING (snapshot_id) WHERE c.is_dir = 0),
p AS (SELECT n.snapshot_id AS later, f.* FROM f JOIN deliv n ON n.snapshot_id = f.next_id)
SELECT f.snapshot_id, f.path_id, CASE WHEN p.path_id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM f LEFT JOIN p ON p.later = f.snapshot_id AND p.path_id = f.path_id
WHERE f.idx > 1 AND (p.path_id IS NULL OR p.size IS DISTINCT FROM f.size OR p.partial_hash IS DISTINCT FROM f.partial_hash)
UNION ALL
SELECT p.later AS snapshot_id, p.path_id, 'removed' AS change
FROM p LEFT JOIN f ON f.snapshot_id = p.later AND f.path_id = p.path_id WHERE f.path_id IS NULL"""

_P2 = f"""WITH {CURRENT}, {DELIVERED},
f AS (SELECT d.drive_id AS dd, c.* FROM cur c JOIN deliv d USING (snapshot_id) WHERE d.next_id IS NULL AND c.is_dir = 0),
dl AS (SELECT label, min(id) AS id FROM drive WHERE label IS NOT NULL GROUP BY label),
a AS (SELECT cp.pair_id, f.* FROM copy_pairs cp JOIN dl ON dl.label = cp.label_a JOIN f ON f.dd = dl.id),
b AS (SELECT cp.pair_id, f.* FROM copy_pairs cp JOIN dl ON dl.label = cp.label_b JOIN f ON f.dd = dl.id),
j AS (SELECT pair_id, path_id, a.id AS ia, b.id AS ib, a.size AS sa, b.size AS sb, a.partial_hash AS pa, b.partial_hash AS pb,
             a.full_hash AS fa, b.full_hash AS fb FROM a FULL JOIN b USING (pair_id, path_id))
SELECT pair_id, path_id, 'only_a' AS diff FROM j WHERE ib IS NULL
UNION ALL SELECT pair_id, path_id, 'only_b' FROM j WHERE ia IS NULL
UNION ALL SELECT pair_id, path_id, 'size' FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND sa IS DISTINCT FROM sb
UNION ALL SELECT pair_id, path_id, 'partial_hash' FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND pa IS DISTINCT FROM pb
UNION ALL SELECT pair_id, path_id, 'full_hash' FROM j WHERE fa <> fb"""

_HASHED = "FROM entries_core WHERE is_dir = 0 AND partial_hash IS NOT NULL"
_P4 = f"""SELECT size, lower(hex(partial_hash)) AS partial_hash {_HASHED} GROUP BY size, entries_core.partial_hash HAVING count(*) * 50 >= (SELECT count(*) {_HASHED})"""

_P6 = """WITH RECURSIVE n AS (
  SELECT 'paths' AS src, id, parent_id AS up FROM paths UNION ALL SELECT 'entries_core', id, parent_id FROM entries_core),
orphan AS (SELECT n.src, n.id FROM n LEFT JOIN n u ON u.src = n.src AND u.id = n.up WHERE n.up IS NOT NULL AND u.id IS NULL),
reach(src, start, node) AS (
  SELECT src, id, up FROM n WHERE up IS NOT NULL
  UNION SELECT r.src, r.start, n.up FROM reach r JOIN n ON n.src = r.src AND n.id = r.node WHERE n.up IS NOT NULL),
cyc AS (SELECT src, start AS id FROM reach WHERE start = node),
bad AS (SELECT src, id FROM cyc UNION SELECT src, id FROM orphan),
below AS (SELECT DISTINCT r.src, r.start AS id FROM reach r JOIN bad ON bad.src = r.src AND bad.id = r.node
          WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.src = r.src AND b.id = r.start)),
built(id, path) AS (SELECT id, segment FROM paths WHERE parent_id IS NULL
  UNION ALL SELECT p.id, b.path || '/' || p.segment FROM built b JOIN paths p ON p.parent_id = b.id)
SELECT src, id AS node_id, 'cycle' AS defect FROM cyc
UNION ALL SELECT src, id, 'orphan' FROM orphan
UNION ALL SELECT src, id, 'below' FROM below
UNION ALL SELECT 'paths', p.id, 'stale_path' FROM built b JOIN paths p ON p.id = b.id WHERE p.full_path <> b.path"""

_TREE = """WITH RECURSIVE built(id, path, depth, root, chain) AS (
  SELECT id, segment, 0, id, [id] FROM paths WHERE parent_id IS NULL
  UNION ALL SELECT p.id, b.path || '/' || p.segment, b.depth + 1, b.root, list_append(b.chain, p.id) FROM built b JOIN paths p ON p.parent_id = b.id)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_per_snapshot": p1_per_snapshot,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_key_totals": p4_key_totals,
    "p4_running": p4_running,
    "p6_found": p6_found,
    "p6_path_tree": p6_path_tree,
    "p6_descendants": p6_descendants,
}

SQL = {
    "p1_found": _P1,
    "p1_per_snapshot": f"SELECT snapshot_id, change, count(*) AS n_files FROM ({_P1}) GROUP BY snapshot_id, change",
    "p2_found": _P2,
    "p4_found": _P4,
    "p4_key_totals": f"""SELECT size, lower(hex(partial_hash)) AS partial_hash, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS n_bytes,
count(DISTINCT drive_id) AS n_drives {_HASHED} GROUP BY size, entries_core.partial_hash""",
    "p4_running": f"""SELECT id, row_number() OVER w AS key_row, CAST(coalesce(sum(size) OVER w, 0) AS BIGINT) AS running {_HASHED}
WINDOW w AS (PARTITION BY size, partial_hash ORDER BY loaded_at NULLS FIRST, id ROWS UNBOUNDED PRECEDING)""",
    "p6_found": _P6,
    "p6_path_tree": f"""{_TREE}, k AS (SELECT unnest(chain) AS id, count(*) - 1 AS n FROM built GROUP BY 1)
SELECT b.id AS node_id, b.path AS built_path, b.depth, b.root, k.n AS n_descendants FROM built b JOIN k ON k.id = b.id""",
    "p6_descendants": f"""{_TREE}, u AS (SELECT id, depth, unnest(chain) AS ancestor, generate_subscripts(chain, 1) AS pos FROM built)
SELECT ancestor, id AS descendant, CAST(depth - pos + 1 AS INTEGER) AS distance FROM u WHERE ancestor <> id""",
}
