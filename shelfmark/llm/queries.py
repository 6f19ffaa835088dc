"""Registered queries of the operators in this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.lookalikes import canonical_paths, lookalike_paths, path_classes
from shelfmark.llm.packing import pack_corpus, packing_summary
from shelfmark.llm.quality import not_prose, text_quality
from shelfmark.llm.survivors import golden_entries, surviving_entries
from shelfmark.llm.tokenizer import decode_corpus, encode_corpus
from shelfmark.runtime import spread_scan
from shelfmark.tables import read_table


def _tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, folder, n) for n in names]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_scan(read_table(spark, folder, "documents").select("doc_id", "text"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_entries(*_tables(spark, folder, "entries_core", "snapshots"))


def p3_golden(spark: SparkSession, folder: str) -> DataFrame:
    return golden_entries(*_tables(spark, folder, "entries_core", "snapshots"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_paths(*_tables(spark, folder, "paths"))


def p5_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_paths(*_tables(spark, folder, "paths"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return path_classes(*_tables(spark, folder, "paths"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_documents(spark, folder))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts decoded from their ids; null texts come back empty."""
    return decode_corpus(encode_corpus(_documents(spark, folder)))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack_corpus(_documents(spark, folder), *_tables(spark, folder, "containers"))


def p8_summary(spark: SparkSession, folder: str) -> DataFrame:
    (containers,) = _tables(spark, folder, "containers")
    return packing_summary(pack_corpus(_documents(spark, folder), containers), containers)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_prose(_documents(spark, folder), *_tables(spark, folder, "common_words"))


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality(_documents(spark, folder), *_tables(spark, folder, "common_words"))


QUERIES = {
    "p3_found": p3_found,
    "p3_golden": p3_golden,
    "p5_found": p5_found,
    "p5_canonical": p5_canonical,
    "p5_classes": p5_classes,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_pack": p8_pack,
    "p8_summary": p8_summary,
    "p9_found": p9_found,
    "p9_stats": p9_stats,
}

_ROWS = """WITH cur AS (
  SELECT * FROM entries_core WHERE snapshot_id IS NOT NULL AND path_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, path_id ORDER BY loaded_at DESC NULLS LAST, id DESC) = 1),
latest AS (
  SELECT id AS snapshot_id, drive_id AS owner, epoch(strptime(taken_at, '%Y-%m-%dT%H:%M:%S')) AS taken_s FROM snapshots
  WHERE id IN (SELECT snapshot_id FROM entries_core)
  QUALIFY row_number() OVER (PARTITION BY drive_id ORDER BY taken_at DESC, id DESC) = 1),
f AS (
  SELECT lower(hex(full_hash)) AS h, c.id, l.owner, c.path_id, c.size, c.inode, c.device, l.taken_s,
         CASE WHEN mtime > 0 AND mtime <= taken_s THEN mtime END AS good,
         inode IS NOT NULL AND device IS NOT NULL AS linked
  FROM cur c JOIN latest l USING (snapshot_id) WHERE is_dir = 0 AND full_hash IS NOT NULL),
g AS (SELECT h FROM f GROUP BY h HAVING count(DISTINCT CASE WHEN linked THEN concat_ws('/', owner, inode, device) ELSE 'id ' || id END) > 1)"""

SQL = {
    "p3_found": f"""{_ROWS}
SELECT h AS full_hash, id AS keep_id FROM f JOIN g USING (h)
QUALIFY row_number() OVER (PARTITION BY h ORDER BY CAST(good IS NOT NULL AS INT) + CAST(linked AS INT) DESC, good DESC NULLS LAST, id) = 1""",
    "p3_golden": f"""{_ROWS}
SELECT h AS full_hash, max(good) AS mtime,
  first(owner ORDER BY linked DESC, taken_s DESC, id) FILTER (linked) AS drive_id,
  first(inode ORDER BY linked DESC, taken_s DESC, id) FILTER (linked) AS inode,
  first(device ORDER BY linked DESC, taken_s DESC, id) FILTER (linked) AS device,
  first(size ORDER BY taken_s DESC, id) FILTER (size IS NOT NULL) AS size,
  first(path_id ORDER BY taken_s DESC, id) AS path_id
FROM f JOIN g USING (h) GROUP BY h""",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
