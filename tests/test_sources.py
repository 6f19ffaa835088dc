import os
import shlex
import sqlite3
from datetime import datetime

import pytest

from shelfmark.functions.hashing import full_file_digest, partial_digest, partial_file_digest
from shelfmark.operators.cleanup import cleanup_plan
from shelfmark.sources import actions, exports, filesystem, sqlite
from shelfmark.sources.store import Store
from pyspark.sql import functions as F

from shelfmark.streaming.arrivals import arriving_totals, first_deliveries, load_totals, read_arrivals, read_totals

GOLDEN = [
    (b"", "c804ce198ec337e3dc762bdd1a09aece"),
    (b"hello\n", "46816a6cc8473f6c2066ce68a9146749"),
    (b"\0" * 196608, "4171aa3da9161376ef740fb718b28553"),
    (b"\0" * 196609, "952fe5ef84a98ee64a09c3eb46f27d90"),
    (bytes(range(256)) * 4096, "8be41785503bf8acf9fd61c3746b9fd0"),
]


@pytest.mark.parametrize("data,digest", GOLDEN, ids=range(len(GOLDEN)))
def test_partial_hashes(tmp_path, data, digest):
    file = tmp_path / "f"
    file.write_bytes(data)
    assert partial_digest(data).hex() == partial_file_digest(file, len(data)).hex() == digest
    assert len(full_file_digest(file)) == 32 and full_file_digest(tmp_path / "none") is None


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "drive"
    for d in ("sub/deep", "OneDrive - Acme", "node_modules", "$RECYCLE.BIN", "ação"):
        (root / d).mkdir(parents=True)
    (root / "alpha.txt").write_text("hello world\n")
    (root / "big.bin").write_bytes(b"x" * 300_000)
    (root / "sub/copy.bin").write_bytes(b"x" * 300_000)
    os.link(root / "big.bin", root / "sub/deep/link.bin")
    os.symlink(root / "alpha.txt", root / "sub/soft.txt")
    os.symlink(root / "sub", root / "folderlink")
    for d in ("OneDrive - Acme", "node_modules", "$RECYCLE.BIN", "ação"):
        (root / d / "f.txt").write_text(d)
    return root


def test_folder_tree(spark, tree):
    filesystem.register(spark)
    rows = {r.rel_path: r for r in spark.read.format("foldertree").option("full", "true").load(str(tree)).collect()}
    assert "$RECYCLE.BIN" not in rows and "OneDrive - Acme/f.txt" in rows
    assert rows["."].is_dir == 1 and rows["."].mtime is None and rows["."].parent_path is None
    assert rows["sub/deep/link.bin"].inode == rows["big.bin"].inode and rows["sub/deep/link.bin"].parent_path == "sub/deep"
    assert rows["sub/copy.bin"].full_hash == rows["big.bin"].full_hash and rows["sub/copy.bin"].size == 300_000
    assert (rows["sub/soft.txt"].is_symlink, rows["sub/soft.txt"].is_dir, rows["sub/soft.txt"].size, rows["sub/soft.txt"].partial_hash) == (1, 0, 0, None)
    assert (rows["folderlink"].is_symlink, rows["folderlink"].is_dir, rows["folderlink"].size) == (1, 1, None) and "folderlink/copy.bin" not in rows
    pruned = spark.read.format("foldertree").option("skip_cloud", "true").option("one_fs", "true").option("exclusions", '["NODE_*", "sub/deep"]').load(str(tree))
    paths = {r.rel_path for r in pruned.collect()}
    assert "sub/copy.bin" in paths and not any(p.startswith(("OneDrive", "node_modules", "sub/deep")) for p in paths)


def test_sqlite_inventories(spark, tmp_path):
    for name, ids in (("a.db", range(1, 6)), ("b.db", range(3, 5))):
        with sqlite3.connect(tmp_path / name) as con:
            con.execute("CREATE TABLE entries (id INTEGER PRIMARY KEY, snapshot_id INTEGER, rel_path TEXT, is_dir INTEGER, size INTEGER, partial_hash BLOB)")
            con.executemany("INSERT INTO entries VALUES (?,?,?,?,?,?)", [(i, 1 + i % 2, f"p{i}", 0, i, b"h") for i in ids])
    (tmp_path / "broken.db").write_text("no database")
    sqlite.register(spark)
    df = spark.read.format("sqliteinventory").option("table", "entries").load(str(tmp_path))
    assert sorted((os.path.basename(r.db), r.id, r.inode) for r in df.collect()) == [("a.db", i, None) for i in range(1, 6)] + [("b.db", 3, None), ("b.db", 4, None)]
    assert {r.id for r in df.where("snapshot_id = 2").collect()} == {1, 3, 5}
    (tmp_path / "empty").mkdir()
    assert spark.read.format("sqliteinventory").load(str(tmp_path / "empty")).count() == 0


def test_store_keeps_refreshes_prunes_and_compacts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1.0, 5, 10), ("a", 2.0, 5, 11), ("b", None, None, 3)], "rel_path string, mtime double, inode long, size long")
    assert [store.write(rows, 1, f"2024-0{m}-01T00:00:00") for m in (1, 2, 3)] == [1, 2, 3]
    assert store.write(rows.where("rel_path = 'b'"), 2, "2024-01-01T00:00:00") == 1
    assert store.write(rows.where("rel_path = 'a'"), 1, "2024-03-02T00:00:00", mode="refresh") == 3
    assert sorted((r.drive_id, r.snapshot_id, r.rel_path, r["size"]) for r in store.entries().collect()) == [(1, 1, "a", 11), (1, 1, "b", 3), (1, 2, "a", 11), (1, 2, "b", 3), (1, 3, "a", 11), (2, 1, "b", 3)]
    store.compact(1, 1)
    assert store.prune(1, "2024-04-01 00:00:00", 1, 0) == [1, 2]
    with pytest.raises(ValueError):
        store.prune(1, "2024-04-01 00:00:00", 0, 0)
    assert store.write(rows, 1, "2024-05-01T00:00:00", mode="fresh") == 1
    assert {(r.drive_id, r.snapshot_id) for r in store.snapshots().select("drive_id", "snapshot_id").collect()} == {(1, 1), (2, 1)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b')], "n long, t string")
    exports.write_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()] == [("1", 'a "q", b')]
    exports.write_csv_file(df.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_bytes() == b'\xef\xbb\xbfn,t,none\r\n1,"a ""q"", b",\r\n'
    exports.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    for outcome in ("ç", "moved"):
        exports.append_audit(spark.createDataFrame([(1, outcome)], "id long, outcome string"), str(tmp_path / "log"))
    assert {r.outcome for r in spark.read.json(str(tmp_path / "log")).where("logged_at is not null").collect()} == {"ç", "moved"}
    (tmp_path / "file").write_text("")
    exports.append_audit(spark.createDataFrame([(1,)], "id long"), str(tmp_path / "file/below"))


NASTY = "IMG[1] o'brien $x `tick ção.bin"


def test_scripts_survive_nasty_names(tmp_path, spark):
    import subprocess

    root, away = tmp_path / "root", tmp_path / "away"
    root.mkdir()
    (root / NASTY).write_text("12345")
    (root / "keep").write_text("12345")
    plan = [
        {"group_id": 1, "rel_path": NASTY, "size": 5, "keeper": "keep", "keep": False},
        {"group_id": 1, "rel_path": "keep", "size": 5, "keeper": "keep", "keep": True},
    ]
    script = exports.cleanup_script(plan, str(root), str(away))
    subprocess.run(["bash", "-c", script], check=True)
    assert os.listdir(root) == ["keep"] and len(os.listdir(away)) == 1
    shell = exports.cleanup_script(plan, "E:/x", "E:/away", "delete", "powershell")
    assert "Remove-Item -LiteralPath 'E:/x/IMG[1] o''brien $x `tick ção.bin'" in shell
    items = [{"drive_id": 1, "path": NASTY}, {"drive_id": 1, "path": "b"}]
    assert shlex.quote(NASTY) in exports.backup_script(items, {1: "/mnt/a"}, "/backup")
    assert "drive 1 isn't mounted: 2 files" in exports.backup_script(items, {}, "/backup")
    copied = exports.backup_script([*items, {"drive_id": 1, "path": "x/100%.txt"}], {1: "E:/"}, "F:/b", tool="robocopy")
    assert f'robocopy "E:\\" "F:\\b\\drive_1" "{NASTY}" "b" /COPY:DAT' in copied and '"E:\\x" "F:\\b\\drive_1\\x" "100%%.txt"' in copied
    assert shell.startswith("\ufeff") and script.startswith("#!/usr/bin/env bash")
    for wrong in ({"action": "burn"}, {"shell": "fish"}):
        with pytest.raises(ValueError):
            exports.cleanup_script(plan, "", "", **wrong)
    with pytest.raises(ValueError):
        cleanup_plan(spark.range(1), "luck")


def test_cleanup_is_carried_out_with_checks(spark, tmp_path):
    root, away = tmp_path / "root", tmp_path / "away"
    (root / "d").mkdir(parents=True)
    outside = tmp_path / "outside"
    outside.write_text("12345")
    for n, text in (("keep", "12345"), ("d/copy", "12345"), ("grown", "123456"), ("other", "54321"), (NASTY, "12345")):
        (root / n).write_text(text)
    os.symlink(root / "keep", root / "link")
    names = ["keep", "d/copy", "grown", "../outside", "missing", "link", NASTY]
    rows = [(1, i, n, 5, "keep", n == "keep") for i, n in enumerate(names)] + [(2, 20, "other", 5, "lost", False)]
    plan = spark.createDataFrame(rows, "group_id long, id long, rel_path string, size long, keeper string, keep boolean")

    def outcomes(**options):
        return {r.rel_path: r.outcome for r in actions.execute(plan, str(root), **options).collect()}

    left = {"grown": "size_changed", "../outside": "outside_root", "missing": "missing", "link": "size_changed", "other": "no_keeper"}
    assert outcomes(quarantine=str(away)) == {**left, "d/copy": "would_do", NASTY: "would_do"}
    assert (root / "d/copy").exists() and not away.exists()
    assert outcomes(quarantine=str(away), dry_run=False) == {**left, "d/copy": "done", NASTY: "done"}
    assert not (root / "d/copy").exists() and len(os.listdir(away)) == 2 and (root / "keep").exists() and outside.exists()
    assert outcomes(quarantine=str(away), dry_run=False)["d/copy"] == "gone"
    (root / "d/copy").write_text("12345")
    assert outcomes(action="delete", dry_run=False)["d/copy"] == "done" and not (root / "d/copy").exists()
    for wrong in ({"action": "burn"}, {"root": str(tmp_path / "unmounted")}):
        with pytest.raises(ValueError):
            actions.execute(plan, **({"root": str(root)} | wrong))


def test_arrivals(spark, tmp_path):
    schema = "id long, snapshot_id long, is_dir int, size long, loaded_at timestamp"
    t = datetime(2024, 1, 1, 10, 5)
    spark.createDataFrame([(1, 1, 0, 5, t), (1, 1, 0, 5, t), (2, 1, 1, None, t)], schema).write.parquet(str(tmp_path / "in"))
    stream = read_arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    assert stream.isStreaming
    for name, df, mode in (("totals", load_totals(stream), "complete"), ("first", first_deliveries(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [tuple(r)[1:] for r in spark.sql("SELECT * FROM totals").collect()] == [(1, 3, 2, 10)]
    assert sorted(r.id for r in spark.sql("SELECT id FROM first").collect()) == [1, 2]


def test_arriving_totals_keep_rows_that_come_late(spark, tmp_path):
    schema = "id long, snapshot_id long, is_dir int, size long, loaded_at timestamp"
    batches = [[(1, 1, 0, 5, datetime(2024, 3, 1, 10))], [(2, 1, 0, 7, datetime(2024, 1, 1, 10)), (3, 1, 1, None, datetime(2024, 3, 1, 10))], [(4, 2, 0, 1, datetime(2023, 1, 1, 10))]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = read_arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
        arriving_totals(stream, str(tmp_path / "totals"), str(tmp_path / "checkpoint")).awaitTermination()
        assert len(os.listdir(tmp_path / "totals")) == n + 1
    got = {tuple(r) for r in read_totals(spark, str(tmp_path / "totals")).collect()}
    assert got == {(datetime(2024, 3, 1, 10), 1, 2, 1, 5), (datetime(2024, 1, 1, 10), 1, 1, 1, 7), (datetime(2023, 1, 1, 10), 2, 1, 1, 1)}


def test_batch_totals_count_late_rows(spark):
    rows = [("2024-03-01 00:00:00", 1, 0, 5), ("2024-01-01 00:00:00", 1, 0, 7)]
    df = spark.createDataFrame(rows, "loaded_at string, snapshot_id long, is_dir int, size long").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    assert sorted(r.n_bytes for r in load_totals(df).collect()) == [5, 7]
