"""Folder roll-ups: sizes, treemap, cold folders, tags by file type, and folder hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.columns import ancestors, base_name, human_size, parent_path, tag_extension
from shelfmark.operators.hierarchy import build_hierarchy
from shelfmark.runtime import drop_materialized, map_arrow, materialize, write_scratch

#: Rows of a whole subtree that one task hashes at most, folder after folder.
BLOCK_ROWS = 200_000

# The default tags and the extensions that give them, in order of precedence.
TAG_RULES = {
    "nanopore": ("pod5", "fast5", "blow5"),
    "NGS": ("fastq", "fq", "fastq.gz", "fq.gz", "bam", "bai", "cram", "crai", "sam"),
    "variantes": ("vcf", "bcf", "gvcf", "vcf.gz", "gvcf.gz", "bcf.gz"),
    "genómica": ("bed", "bedgraph", "bigwig", "bw", "bigbed", "bb", "gtf", "gff", "gff3", "gff2", "fasta", "fa", "fna", "faa", "ffn"),
    "imagiologia": ("dcm", "dicom"),
    "PDF": ("pdf",),
    "documentos": ("docx", "doc", "odt", "rtf", "pages", "tex"),
    "tabelas": ("xlsx", "xls", "ods", "csv", "tsv"),
    "apresentações": ("pptx", "ppt", "odp", "key"),
    "música": ("mp3", "flac", "wav", "ogg", "aac", "m4a", "opus", "wma", "alac", "aiff"),
    "vídeo": ("avi", "mp4", "mkv", "mov", "wmv", "webm", "m4v", "mpg", "mpeg", "mts", "ts", "vob"),
    "imagens": ("jpg", "jpeg", "png", "gif", "tiff", "tif", "heic", "heif", "raw", "cr2", "nef", "arw", "dng", "orf", "rw2", "bmp", "webp"),
    "código": ("py", "r", "rmd", "qmd", "ipynb", "jl", "m", "scala"),
    "scripts": ("sh", "bash", "zsh", "fish", "ps1", "cmd", "bat", "nf"),
    "arquivo": ("zip", "tar", "gz", "bz2", "xz", "7z", "rar", "tar.gz", "tar.bz2", "tar.xz"),
    "base de dados": ("db", "sqlite", "sqlite3"),
}


def _by_folder(files: DataFrame) -> DataFrame:
    """Bytes, files and newest time per folder that directly holds files.

    Reducing to folders before going up the ancestors keeps the explosion to
    folders times depth.
    """
    return files.groupBy("drive_id", parent_path(F.col("rel_path")).alias("folder")).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("mtime").alias("newest")
    )


def _upwards(per_folder: DataFrame) -> DataFrame:
    own = F.when(F.col("folder") == ".", F.array(F.lit("."))).otherwise(F.array_append(ancestors(F.col("folder")), F.col("folder")))
    return (
        per_folder.select("drive_id", F.explode(own).alias("folder"), "bytes", "n", "newest")
        .groupBy("drive_id", "folder")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("newest").alias("newest"))
    )


def folder_sizes(latest: DataFrame) -> DataFrame:
    """Bytes and files below every folder of a drive, '.' included."""
    return _upwards(_by_folder(latest.where("is_dir = 0"))).select("drive_id", "folder", "bytes", F.col("n").alias("n_files"))


def treemap_rows(latest: DataFrame, min_size: int = 100 << 20, files: bool = False) -> DataFrame:
    """Rows of a treemap: folders of at least ``min_size`` with their parents, and optionally such files.

    A folder's parents hold at least as much, so the tree stays connected.
    """
    sizes = folder_sizes(latest).where(F.col("bytes") >= min_size)
    up = F.when(F.col("folder") == ".", F.lit("")).otherwise(parent_path(F.col("folder")))
    name = F.when(F.col("folder") == ".", F.lit("/")).otherwise(F.concat(base_name(F.col("folder")), F.lit("/")))
    out = sizes.select("drive_id", F.col("folder").alias("node"), up.alias("parent"), name.alias("name"), F.col("bytes").alias("size"), F.lit("dir").alias("kind"))
    if files:
        big = latest.where("is_dir = 0").where(F.col("size") >= min_size)
        out = out.unionByName(big.select("drive_id", F.col("rel_path").alias("node"), parent_path(F.col("rel_path")).alias("parent"), base_name(F.col("rel_path")).alias("name"), "size", F.lit("file").alias("kind")))
    return out.withColumn("size_human", human_size(F.col("size")))


def cold_folders(latest: DataFrame, cutoff: float, min_size: int = 100 << 20) -> DataFrame:
    """Topmost folders in which no file is newer than ``cutoff`` (Unix seconds)."""
    usable = latest.where("is_dir = 0 and error is null and mtime is not null")
    cold = materialize(_upwards(_by_folder(usable)).where((F.col("newest") < cutoff) & (F.col("folder") != ".")), "cold")
    above = cold.select("drive_id", F.col("folder").alias("parent"))
    return (
        cold.withColumn("parent", parent_path(F.col("folder")))
        .join(above, ["drive_id", "parent"], "left_anti")
        .where(F.col("bytes") >= min_size)
        .select("drive_id", "folder", F.col("bytes").alias("size"), F.col("newest").alias("newest_mtime"), F.col("n").alias("file_count"))
    )


def auto_tags(latest: DataFrame, rules: dict[str, tuple[str, ...]] = TAG_RULES) -> DataFrame:
    """(drive_id, folder, tags): tags of the file types directly in a folder, in the rules' order."""
    extensions = {e for exts in rules.values() for e in exts}
    spark = latest.sparkSession
    table = spark.createDataFrame([(i, tag, e) for i, (tag, exts) in enumerate(rules.items()) for e in exts], "rule int, tag string, ext string")
    files = latest.where("is_dir = 0 and error is null")
    seen = files.select("drive_id", parent_path(F.col("rel_path")).alias("folder"), tag_extension(F.col("rel_path"), [e for e in extensions if "." in e]).alias("ext")).distinct()
    # The rules are a parameter of some hundred rows.
    hits = seen.join(F.broadcast(table), "ext").groupBy("drive_id", "folder").agg(F.sort_array(F.collect_set(F.struct("rule", "tag"))).alias("t"))
    return hits.select("drive_id", "folder", F.array_join("t.tag", "|").alias("tags"))


def _digest(algorithm: str):
    """Digests of runs of children in order; a folder of any size takes no more memory than a batch.

    Folders of earlier runs of the same block are looked up among the digests made so
    far; a child without a hash leaves its folder without one.
    """

    def fresh():
        return hashlib.blake2b(digest_size=32) if algorithm == "blake2b" else hashlib.new(algorithm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, bytes] = {}
        block, at, h = None, None, None
        for batch in batches:
            ids, out = [], []
            for own, parent, name, kid, is_dir, digest in zip(*(batch[c].to_pylist() for c in ("block", "parent_id", "name", "id", "is_dir", "hash"))):
                if parent != at:
                    if h is not None:
                        done[at] = h.digest()
                        ids.append(at)
                        out.append(done[at])
                    at, h = parent, fresh()
                    if own != block:
                        block, done = own, {}
                if h is None:
                    continue
                if is_dir and digest is None:
                    digest = done.get(kid)
                if digest is None:
                    h = None
                    continue
                h.update((b"D" if is_dir else b"F") + name.encode("utf-8", "replace") + digest)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "hash"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([h.digest()], pa.binary())], names=["id", "hash"])

    return run


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """(parent_id, level, block) of the folders that aren't on cycles.

    ``block`` is the topmost folder above (or the folder itself) whose whole subtree
    has at most ``block_rows`` rows; null for folders with more.
    """
    tree = materialize(build_hierarchy(rows.where("is_dir = 1"), "id", "parent_id", chains=True).where("chain is not null").select("id", "level", "chain"), "folder-tree")
    held = rows.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    lines = materialize(tree.select("id", F.posexplode("chain").alias("at", "above")), "folder-lines")
    small = lines.join(held, "id").groupBy("above").agg(F.sum("n").alias("n")).where(F.col("n") <= block_rows).select("above")
    tops = lines.join(small, "above").groupBy("id").agg(F.min(F.struct("at", "above")).alias("top"))
    return tree.join(tops, "id", "left").select(F.col("id").alias("parent_id"), "level", F.col("top.above").alias("block"))


def folder_hashes(rows: DataFrame, algorithm: str = "blake2b", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, hash) of folders from names and hashes of all that is below, bottom up.

    ``rows``: id, parent_id, name, is_dir, hash (files'). Children go in order of
    name (then id), each as kind, name and hash. A folder without children, or with
    one that has no hash, has none and isn't in the result; nor are folders on
    cycles. Whole subtrees of at most ``block_rows`` rows are hashed by one task each,
    the deepest folders first; the folders above them follow level by level, on all
    executors. A null name counts as empty, a null id as no row.
    """
    rows = rows.where("id is not null").select("id", "parent_id", F.coalesce("name", F.lit("")).alias("name"), F.col("is_dir").cast("int").alias("is_dir"), "hash")
    rows = materialize(rows.withColumn("hash", F.when(F.col("is_dir") == 0, F.col("hash"))), "merkle-rows")
    kids = materialize(rows.join(_blocks(rows, block_rows), "parent_id"), "merkle-kids")
    schema, order = "id long, hash binary", [F.col("block"), F.desc("level"), F.col("parent_id"), F.col("name"), F.col("id")]

    def hashed(parts: DataFrame, by: str, label: str) -> str:
        return write_scratch(map_arrow(parts.repartition(by).sortWithinPartitions(*order), _digest(algorithm), schema), label)

    written = [hashed(kids.where("block is not null"), "block", "merkle-blocks")]
    upper = kids.where("block is null")
    top = upper.agg(F.max("level")).first()[0]
    for level in range(-1 if top is None else top, -1, -1):
        known = rows.sparkSession.read.schema(schema).parquet(*written)
        now = upper.where(F.col("level") == level)
        subfolders = now.where("is_dir = 1").drop("hash").join(known, "id", "left").select(*now.columns)
        written.append(hashed(now.where("is_dir = 0").unionByName(subfolders), "parent_id", f"merkle-{level}"))
    drop_materialized(kids)
    return rows.sparkSession.read.schema(schema).parquet(*written)


def linked_rows(latest: DataFrame, entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of ``latest`` as :func:`folder_hashes` takes them, with ``drive_id``.

    ``parent_id`` names a folder's row as delivered in ``entries``; it becomes the
    id of the current row of that folder in the same snapshot, as a folder may
    have been delivered again. Where no such row exists, the folder of the path
    counts, so that no folder is hashed without one of its children. Names are
    the paths' own, since a stored full_path may be missing or out of date.
    """
    given = entries.where("is_dir = 1 and path_id is not null").groupBy(F.col("id").alias("parent_id"), "snapshot_id").agg(F.min("path_id").alias("linked"))
    own = paths.where("id is not null").select(F.col("id").alias("path_id"), "segment", F.col("parent_id").alias("path_parent"))
    up = latest.where("is_dir = 1").select("snapshot_id", F.col("path_id").alias("up"), F.col("id").alias("folder"))
    return (
        latest.join(given, ["parent_id", "snapshot_id"], "left")
        .join(own, "path_id", "left")
        .withColumn("up", F.when(F.col("parent_id").isNotNull(), F.coalesce("linked", "path_parent")))
        .join(up, ["snapshot_id", "up"], "left")
        .select("drive_id", "id", F.col("folder").alias("parent_id"), F.coalesce("segment", base_name(F.col("rel_path"))).alias("name"), "is_dir", F.col("full_hash").alias("hash"))
    )


def duplicate_folders(hashed: DataFrame) -> DataFrame:
    """Groups of folders of a drive with equal hash: drive_id, hash, n, first id."""
    return hashed.groupBy("drive_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")
