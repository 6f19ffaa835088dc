import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.columns import UNITS, ancestors, first_dot_extension, human_size, parent_path, same_mtime, tag_extension, top_folder
from shelfmark.functions.text import glob_to_regex, nfc
from shelfmark.inventory import COLUMNS, all_entries
from shelfmark.operators import cleanup, cross, diff, duplicates, folders, upkeep
from shelfmark.plans.search import QueryError, parse_dates, parse_query, parse_size, search, search_total, split_terms


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_path_columns(spark):
    p = F.col("p")
    got = values(spark, [("a",), ("a/b.tar.GZ",), ("x/y/z.fastq.gz",), ("x/.bashrc",), ("x/a.",)], "p string", parent_path(p), ancestors(p), first_dot_extension(p), tag_extension(p, ["fastq.gz", "tar.gz"]), top_folder(p))
    assert got == [
        (".", ["."], "(no ext)", "", "a"), ("a", [".", "a"], "tar.gz", "tar.gz", "a"), ("x/y", [".", "x", "x/y"], "fastq.gz", "fastq.gz", "x/y"),
        ("x", [".", "x"], "bashrc", "bashrc", "x"), ("x", [".", "x"], "", "", "x"),
    ]


def python_human(n):
    v = float(n or 0)
    for unit in UNITS[:-1]:
        if v < 1024:
            return f"{v:.1f} {unit}"
        v /= 1024
    return f"{v:.1f} {UNITS[-1]}"


def test_human_sizes_round_as_python(spark):
    random.seed(1)
    sizes = [None, 0, 1023, 1024, 1280, 1152, 3 << 60, *[random.randrange(1 << random.randint(1, 62)) for _ in range(500)]]
    got = values(spark, [(s,) for s in sizes], "n long", human_size(F.col("n")))
    assert [g[0] for g in got] == [python_human(s) for s in sizes]


@pytest.mark.parametrize("d,same", [(0, True), (1.9, True), (3600, True), (5 * 3600 + 1.5, True), (26 * 3600, True), (3, False), (27 * 3600, False), (1800, False), (3630, False)])
def test_times_that_count_as_the_same(spark, d, same):
    assert values(spark, [(100_000.0, 100_000.0 + d)], "a double, b double", same_mtime(F.col("a"), F.col("b")), same_mtime(F.col("b"), F.col("a"))) == [(same, same)]


def test_composed_form(spark):
    assert values(spark, [("Investigação",), ("abc",), (None,)], "t string", nfc(F.col("t"))) == [("Investigação",), ("abc",), (None,)]


def test_globs():
    import re

    def fits(glob, name):
        return re.match(glob_to_regex(glob), name) is not None

    assert fits("*.mkv", "a.mkv") and not fits("*.mkv", "a.mkv2") and fits("a?c", "abc") and fits("[ab]x", "bx") and not fits("[!ab]x", "bx")
    assert fits("a.b", "a.b") and not fits("a.b", "axb") and fits("[x", "[x") and fits("a+(b)", "a+(b)")


def test_search_parsing():
    assert [parse_size(t) for t in ("512", "512B", "20GB", "20 gb", "1,5TB")] == [512, 512, 20 << 30, 20 << 30, int(1.5 * (1 << 40))]
    assert parse_dates("2024-02") == (1706745600.0, 1709251200.0) and parse_dates("2024-12")[1] == parse_dates("2025")[0]
    assert split_terms("a 'b c' d\"e f\"") == ["a", "b c", "de f"]
    s = parse_query(">1KB size<=2KB modified>=2024 modified<2025 type:pasta path:x drive:A name:*.mkv foo")
    assert (s.size.low, s.size.high, s.is_dir, s.paths, s.drives, s.names) == (1025, 2048, 1, ["x"], ["A"], ["*.mkv", "foo"])
    assert (s.mtime.low, s.mtime.high) == (parse_dates("2024")[0], parse_dates("2025")[0])
    for query in ("modified>=2024-06 modified:2024", "modified:2024 modified>=2024-06"):
        assert parse_query(query).mtime == parse_query("modified>=2024-06 modified<=2024").mtime
    assert split_terms("a\"b  c'd\" 'open end") == ["ab  c'd", "open end"] and split_terms("'' \"\"") == []
    assert parse_query("size>=1KB size=2KB").size == parse_query("size=2KB").size
    for bad in ("", "  ", "size:GB", "color:red", "type:thing", "modified:2024-13", "modified:2024-02-31", ">=0B", ">-5GB"):
        with pytest.raises(QueryError):
            parse_query(bad)


ROW = "drive_id long, drive string, snapshot_id long, idx int, is_latest boolean, id long, parent_id long, path_id long, rel_path string, is_dir int, size long, mtime double, partial_hash binary, full_hash binary, is_symlink int, error string, inode long, device long"


@pytest.fixture
def make(spark):
    def build(*rows):
        base = dict.fromkeys(COLUMNS) | {"drive_id": 1, "snapshot_id": 1, "idx": 1, "is_latest": True, "is_dir": 0, "is_symlink": 0}
        return spark.createDataFrame([tuple((base | {"id": i, "path_id": i} | r)[c] for c in COLUMNS) for i, r in enumerate(rows, 1)], ROW)

    return build


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def file(path, size, key=b"k", full=None, **more):
    return {"rel_path": path, "size": size, "partial_hash": key, "full_hash": full, "mtime": 1.0} | more


def test_search_on_rows(make):
    df = make(file("STP/notes.txt", 10), file("HD Movies/Filme Ção.mkv", 3 << 20), {"rel_path": "STP", "is_dir": 1}, file("x/pequeno.mkv", 512))
    assert rows_of(search(df, "*.mkv >1MB"), "rel_path") == [("HD Movies/Filme Ção.mkv",)]
    assert rows_of(search(df, "ção"), "rel_path") == [("HD Movies/Filme Ção.mkv",)]
    assert rows_of(search(df, "path:'hd movies'"), "rel_path") == [("HD Movies/Filme Ção.mkv",)]
    assert rows_of(search(df, "type:dir stp"), "rel_path", "size") == [("STP", 0)]
    assert [r.rel_path for r in search(df, "*.mkv", limit=1).collect()] == ["HD Movies/Filme Ção.mkv"]
    assert tuple(search_total(df, "*.mkv", 1).first()) == ("*.mkv", 2, True) and tuple(search_total(df, "*.mkv", 2).first())[1:] == (2, False)
    two = make(file("a.txt", 5, drive="Atlas-01"), file("b.txt", 5, drive_id=2, drive="Vault"), file("c.txt", 5, drive_id=3))
    assert rows_of(search(two, 'drive:"atlas-01" *.txt'), "drive", "rel_path") == [("Atlas-01", "a.txt")]
    assert rows_of(search(two, "drive:vault drive:atlas-01"), "rel_path") == [("a.txt",), ("b.txt",)]


def test_file_groups_confirmed_or_not(make):
    df = make(
        file("a", 5000, b"1", b"x"), file("b", 5000, b"1", b"x"), file("c", 5000, b"1", b"y"),
        file("d", 5000, b"2", b"z"), file("e", 5000, b"2", None),
        file("f", 5000, b"3", b"w", inode=1, device=1), file("g", 5000, b"3", b"w", inode=1, device=1),
        file("h", 5000, b"4", b"v", inode=2, device=1), file("i", 5000, b"4", b"v", inode=2, device=1), file("j", 5000, b"4", b"v"),
    )
    got = rows_of(duplicates.file_groups(df), "hash", "confirmed", "n", "hardlinks", "wasted")
    assert got == sorted([(b"x".hex(), True, 2, 0, 5000), (b"2".hex(), False, 2, 0, 5000), (b"v".hex(), True, 2, 1, 5000)], key=str)
    assert duplicates.file_groups(df.where("false")).count() == 0


def test_cleanup_keeps_one_and_skips_links(make):
    df = make(
        file("orig.bin", 5000, b"1", b"x", mtime=5.0, inode=1), file("sub/copy.bin", 5000, b"1", b"x", mtime=3.0, inode=2), file("a/very/long", 5000, b"1", b"x", mtime=0.0, inode=3),
        file("hl", 5000, b"2", b"a", inode=9), file("hl2", 5000, b"2", b"a", inode=9),
    )
    for strategy, keeper in (("shortest", "orig.bin"), ("oldest", "sub/copy.bin"), ("newest", "orig.bin"), ("alphabetical", "a/very/long")):
        plan = cleanup.cleanup_plan(df, strategy, 1)
        assert rows_of(plan.where("keep"), "rel_path", "group_id", "n_copies") == [(keeper, 2, 3)]
        assert rows_of(cleanup.plan_groups(plan), "n_actions", "freeable") == [(2, 10_000)]


def test_pair_comparison(make):
    a = make(file("s", 5000, b"1", b"x"), file("t", 5000, b"2", b"x"), file("u", 5000, b"3", b"x"), file("only", 5000, b"4"))
    b = make(file("s", 5000, b"1", b"x"), file("s2", 5000, b"1", None), file("t", 5000, b"2", b"OTHER"), file("u", 5000, b"3", None))
    assert rows_of(cross.compare_matches(a, b), "rel_path", "n_in_b", "confirmed") == [("s", 2, True), ("u", 1, False)]
    assert rows_of(cross.compare_summary(a, b), "matched_files", "confirmed_files", "only_in_a") == [(2, 1, 1)]


def test_single_copies_need_two_drives(make):
    one = make(file("a", 5000, b"1"), file("aa", 5000, b"1"))
    assert cross.single_copies(one, 1).count() == 0
    two = make(file("a", 5000, b"1"), file("aa", 5000, b"1"), file("b", 5000, b"2", b"x"), file("b", 5000, b"2", b"y", drive_id=2), file("c", 5000, b"3"), file("c", 5000, b"3", b"z", drive_id=2))
    assert rows_of(cross.single_copies(two, 1), "drive_id", "path", "internal_copies") == [(1, "a", 2), (1, "b", 1), (2, "b", 1)]


def test_diff_with_composed_names(make):
    old = make(file("proj/a.txt", 5), file("proj/b.txt", 4), file("Investigação/x", 7), file("São/y", 7))
    new = make(file("proj/a.txt", 20), file("none", 1), file("Investigação/x", 7, path_id=30), file("São/y", 9, path_id=40), file("proj/c.txt", 5, path_id=50)).where("rel_path <> 'none'")
    d = diff.snapshot_diff(old, new)
    assert rows_of(d, "change", "rel_path", "old_size", "new_size") == [("added", "proj/c.txt", None, 5), ("modified", "São/y", 7, 9), ("modified", "proj/a.txt", 5, 20), ("removed", "proj/b.txt", 4, None)]
    assert rows_of(diff.diff_summary(d), "added_count", "removed_count", "modified_count", "modified_delta_bytes") == [(1, 1, 2, 17)]
    assert rows_of(diff.top_changes(d, "growth", 1), "folder", "growth") == [("proj", 16)]


def test_retention(spark):
    s = spark.createDataFrame([(i, 1, f"2024-0{i}-01T00:00:00") for i in range(1, 6)] + [(6, 1, "broken")], "id long, drive_id long, taken_at string")
    assert rows_of(diff.snapshot_retention(s, "2024-06-01 00:00:00", 2, 0).where("keep"), "snapshot_id") == [(5,), (6,)]
    assert rows_of(diff.snapshot_retention(s, "2024-06-01 00:00:00", 1, 3).where("keep"), "snapshot_id") == [(3,), (4,), (5,), (6,)]


def digest(*parts):
    h = hashlib.blake2b(digest_size=32)
    for p in parts:
        h.update(p)
    return h.digest()


@pytest.mark.parametrize("block", [10**6, 2, 0])
def test_folder_hashes(spark, block):
    rows = [(1, None, "r", 1, None), (2, 1, "b", 1, None), (3, 1, "a", 0, b"1"), (4, 2, "f", 0, b"2"), (5, None, "s", 1, None), (6, 5, "open", 0, None), (7, None, "empty", 1, None),
            (8, 9, "x", 1, None), (9, 8, "y", 1, None), (10, None, "t", 1, None), (11, 10, "f", 0, b"2"), (12, 5, "deep", 1, None), (13, 12, "f", 0, b"2")]
    df = spark.createDataFrame(rows, "id long, parent_id long, name string, is_dir int, hash binary")
    got = {r.id: bytes(r.hash) for r in folders.folder_hashes(df, block_rows=block).collect()}
    leaf = digest(b"Ff", b"2")
    assert got == {2: leaf, 10: leaf, 12: leaf, 1: digest(b"Fa", b"1", b"Db", leaf)}
    assert folders.folder_hashes(df.where("false"), block_rows=block).count() == 0


def test_tags_reuse_and_verification(spark, make):
    meta = spark.createDataFrame([(1, "a", '["Raw", "lab"]', None, ""), (1, "b", "", "LABEL", ""), (1, "c", "broken", None, "")], "drive_id long, rel_path string, tags string, note string, updated_at string")
    assert rows_of(upkeep.tag_search(meta, "LAB"), "rel_path", "tags") == [("a", "Raw|lab"), ("b", "")]
    assert upkeep.upsert_meta(meta, meta.where("rel_path = 'a'").withColumn("note", F.lit("n"))).where("note = 'n'").count() == 1
    old = make(file("ç/a", 5, b"1", b"f"), file("b", 5, b"2"), file("c", 6, b"3"))
    new = make(file("ç/a", 5, mtime=3601.0, path_id=9), file("b", 6), file("c", 6, b"9"))
    assert rows_of(upkeep.reuse_hashes(old, new), "id", "from_id", "full_hash") == [(1, 1, bytearray(b"f")), (3, 3, None)]
    assert rows_of(upkeep.verify(old, new), "status", "n") == [("corrupted", 1), ("missing", 1), ("size_changed", 1)]


def test_entries_keep_rows_without_path_text(spark):
    t = datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, 1, 1, 7, None, 0, 5, None, None, None, 0, None, None, None, t, "x")], "id long, drive_id long, snapshot_id long, path_id long, parent_id long, is_dir int, size long, mtime double, partial_hash binary, full_hash binary, is_symlink int, error string, inode long, device long, loaded_at timestamp, rel_path string")
    s = spark.createDataFrame([(1, 1, "2024-01-01T00:00:00", "l")], "id long, drive_id long, taken_at string, label string")
    p = spark.createDataFrame([(7, None)], "id long, full_path string")
    d = spark.createDataFrame([(1, "Vault"), (2, None)], "id long, label string")
    assert rows_of(all_entries(e, s, p, d, latest_only=True), "rel_path", "drive_id", "drive") == [("#7", 1, "Vault")]
    assert all_entries(e.where("false"), s, p, d).count() == 0


def test_llm_is_used_by_nothing_else():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "shelfmark"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "shelfmark.llm" not in f.read_text(encoding="utf-8")


def test_equal_folders_come_out_as_groups(spark, tmp_path):
    from shelfmark.inventory_queries import QUERIES

    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    paths = [
        (1, None, "a", "a"), (2, 1, "f", "a/f"), (3, None, "b", "b"), (4, 3, "f", None), (5, None, "c", "c"), (6, 5, "f", "c/f"), (7, 5, "g", None),
        (8, None, "d", "d"), (9, 8, "f", "d/f"), (10, 8, "x", "d/x"), (11, None, "e", "e"), (12, 11, "s", "old/s"), (13, 12, "f", "e/s/f"),
    ]
    x, y = b"x" * 32, b"y" * 32
    entries = [
        # Drive 1: a, b and e/s hold the same file; b's folder was delivered again after its child; c and d hold more, d's second file by a broken link.
        (1, 1, 10, 1, None, 1, None, t1), (2, 1, 10, 2, 1, 0, x, t1), (3, 1, 10, 3, None, 1, None, t1), (4, 1, 10, 4, 3, 0, x, t1), (30, 1, 10, 3, None, 1, None, t2),
        (5, 1, 10, 5, None, 1, None, t1), (6, 1, 10, 6, 5, 0, x, t1), (7, 1, 10, 7, 5, 0, y, t1), (8, 1, 10, 8, None, 1, None, t1), (9, 1, 10, 9, 8, 0, x, t1), (10, 1, 10, 10, 999, 0, y, t1),
        (11, 1, 10, 11, None, 1, None, t1), (12, 1, 10, 12, 11, 1, None, t1), (13, 1, 10, 13, 12, 0, x, t1),
        # Drive 2: one folder like a, and one whose file has no hash; an older snapshot of it doesn't count.
        (21, 2, 20, 1, None, 1, None, t1), (22, 2, 20, 2, 21, 0, x, t1), (23, 2, 20, 3, None, 1, None, t1), (24, 2, 20, 4, 23, 0, None, t1),
        (25, 2, 19, 1, None, 1, None, t1), (26, 2, 19, 2, 25, 0, x, t1), (27, 2, 19, 3, None, 1, None, t1), (28, 2, 19, 4, 27, 0, x, t1),
    ]
    spark.createDataFrame(paths, "id long, parent_id long, segment string, full_path string").write.parquet(f"{tmp_path}/paths.parquet")
    rows = spark.createDataFrame(entries, "id long, drive_id long, snapshot_id long, path_id long, parent_id long, is_dir int, full_hash binary, loaded_at timestamp")
    for c in ("size long", "mtime double", "partial_hash binary", "is_symlink int", "error string", "inode long", "device long"):
        rows = rows.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
    rows.write.parquet(f"{tmp_path}/entries_core.parquet")
    snapshots = [(10, 1, "2024-01-01T00:00:00", None), (19, 2, "2024-01-01T00:00:00", None), (20, 2, "2024-01-02T00:00:00", None)]
    spark.createDataFrame(snapshots, "id long, drive_id long, taken_at string, label string").write.parquet(f"{tmp_path}/snapshots.parquet")
    assert rows_of(QUERIES["merkle_dir_groups"](spark, str(tmp_path)), "drive_id", "hash", "n", "first_id") == [(1, digest(b"Ff", x).hex(), 3, 1)]


def test_recorded_totals_are_held_against_rows(spark):
    from shelfmark.inventory_queries import QUERIES

    t = datetime(2024, 1, 1)
    entries = [(i, 1, i, 0, 0, t) for i in range(1, 21)] + [(21, 1, 21, 1, 0, t), (22, 1, 22, 0, 1, t), (23, 1, 1, 0, 0, t)] + [(30, 3, 1, 0, None, t), (40, 5, 1, 0, 0, t), (41, 6, 1, 1, 0, t)]
    e = spark.createDataFrame(entries, "id long, snapshot_id long, path_id long, is_dir int, is_symlink int, loaded_at timestamp")
    s = spark.createDataFrame([(1, 1, 21, 2), (2, 1, 10, 2), (3, 1, 2, 0), (4, 1, None, None), (5, 1, None, 2), (6, 1, 0, 2)], "id long, drive_id long, total_files long, total_dirs long")
    got = rows_of(upkeep.entry_counts(s, e), "snapshot_id", "ok", "n_files", "n_dirs")
    assert got == [(1, True, 20, 1), (2, False, 0, 0), (3, False, 1, 0), (4, True, 0, 0), (5, False, 1, 0), (6, True, 0, 1)]
    assert "doctor_entry_counts" in QUERIES
