import hashlib
import os
import sqlite3
import unicodedata

from shelfmark.operators.folders import TAG_RULES
from shelfmark.sources import ingest, registry
from shelfmark.sources.store import Store


def test_a_whole_journey(spark, tmp_path):
    root = tmp_path / "drive"
    for folder in ("a", "b"):
        (root / folder).mkdir(parents=True)
        (root / folder / "x.bam").write_bytes(b"x" * 5000)
    (root / "own.txt").write_text("own")
    store = Store(spark, str(tmp_path / "store"))
    assert ingest.index(spark, store, str(root), 1, "2024-01-01T00:00:00", full=True) == 1
    # A file that keeps size and time keeps its hash though its content changed; a new size is read.
    times = os.stat(root / "a/x.bam")
    (root / "a/x.bam").write_bytes(b"y" * 5000)
    os.utime(root / "a/x.bam", (times.st_atime, times.st_mtime))
    (root / "own.txt").write_text("longer")
    assert ingest.index(spark, store, str(root), 1, "2024-02-01T00:00:00") == 2
    rows = {(r.snapshot_id, r.rel_path): r for r in store.entries().collect()}
    whole = hashlib.blake2b(b"x" * 5000, digest_size=32).digest()
    assert bytes(rows[1, "a/x.bam"].full_hash) == bytes(rows[2, "a/x.bam"].full_hash) == whole
    assert rows[2, "own.txt"].full_hash is None and rows[2, "own.txt"].partial_hash != rows[1, "own.txt"].partial_hash
    first = store.entries().where("snapshot_id = 1")
    hashes = {r.rel_path: bytes(r.hash) for r in ingest.stored_folder_hashes(first).collect()}
    assert hashes["a"] == hashes["b"] == hashlib.blake2b(b"Fx.bam" + whole, digest_size=32).digest() and set(hashes) == {"a", "b", "."}
    assert ingest.index(spark, store, str(root), 1, "2024-02-02T00:00:00", mode="refresh") == 2
    again = {r.rel_path: r.full_hash for r in store.entries().where("snapshot_id = 2").collect()}
    assert bytes(again["a/x.bam"]) == whole and len(again) == 6
    assert ingest.index(spark, store, str(root), 1, "2024-03-01T00:00:00", mode="fresh", exclusions=("b",)) == 1
    latest = store.entries().selectExpr("*", "monotonically_increasing_id() AS id")
    assert {r.rel_path for r in latest.collect()} == {".", "a", "a/x.bam", "own.txt"}
    assert ingest.confirm(latest, str(root)).count() == 0


def test_a_folder_met_twice_is_walked_once(spark, tmp_path):
    rows = [("a", 1, 1), ("a/f", 0, 2), ("b", 1, 1), ("b/f", 0, 2), ("b/c", 1, 3), ("b/c/g", 0, 4), ("c", 1, 5), ("ab", 0, 6)]
    df = spark.createDataFrame([(p, d, 0, i, 9) for p, d, i in rows], "rel_path string, is_dir int, is_symlink int, inode long, device long")
    assert {r.rel_path for r in ingest.without_repeats(df).collect()} == {"a", "a/f", "b", "c", "ab"}
    for n in range(70):
        (tmp_path / f"deep/d{n}/e").mkdir(parents=True)
        (tmp_path / f"deep/d{n}/e/f").write_text("x")
    found = ingest.walk(spark, str(tmp_path))
    paths = [r.rel_path for r in found.collect()]
    assert len(paths) == len(set(paths)) == 2 + 70 * 3


def test_taking_snapshots_drops_old_ones(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/f").write_text("x")
    store = Store(spark, str(tmp_path / "store"))
    taken = [ingest.take(spark, store, str(tmp_path / "d"), 1, f"2024-01-0{n}T00:00:00", keep_last=2, keep_monthly=0) for n in (1, 2, 3)]
    assert taken == [(1, []), (2, []), (3, [1])] and {r.snapshot_id for r in store.snapshots().collect()} == {2, 3}


def test_confirm_reads_only_candidates(spark, tmp_path):
    for name, content in (("p", b"1" * 2000), ("q", b"1" * 2000), ("r", b"2" * 2000)):
        (tmp_path / name).write_bytes(content)
    rows = [(1, "p", b"k"), (2, "q", b"k"), (3, "r", b"l")]
    df = spark.createDataFrame([(1, i, n, 0, 2000, k, None, None) for i, n, k in rows], "drive_id long, id long, rel_path string, is_dir int, size long, partial_hash binary, full_hash binary, error string")
    got = {r.id: bytes(r.full_hash) for r in ingest.confirm(df, str(tmp_path)).collect()}
    assert got == dict.fromkeys((1, 2), hashlib.blake2b(b"1" * 2000, digest_size=32).digest())


def test_registry(spark, tmp_path):
    def make(name, *statements):
        with sqlite3.connect(tmp_path / name) as con:
            for s in statements:
                con.execute(s)

    drive, snaps, entries = "CREATE TABLE drive (label)", "CREATE TABLE snapshots (id)", "CREATE TABLE entries (id)"
    fill = "INSERT INTO {} VALUES (1)".format
    make("a.db", drive, fill("drive"), snaps, fill("snapshots"), entries, fill("entries"))
    make("b.db", drive, fill("drive"), snaps, fill("snapshots"), entries)
    make("c.db", drive, fill("drive"), snaps)
    make("d.db", drive)
    (tmp_path / "e.db").write_text("x" * 5000)
    make("f.db", drive)
    states = {os.path.basename(f): s for f, s in registry.import_folder(str(tmp_path), {str(tmp_path / "f.db")})}
    assert states == {"a.db": "ok", "b.db": "partial", "c.db": "empty", "d.db": "no_drive", "e.db": "unreadable", "f.db": "registered"}
    drives = spark.createDataFrame([(1, "x"), (2, None)], "id long, label string")
    assert sorted(tuple(r) for r in registry.drop_drive(registry.rename_drive(drives, 2, "new"), 1).collect()) == [(2, "new")]
    (tmp_path / "rules.yaml").write_text("docs: [.PDF, txt]\nnone: []\n")
    assert registry.tag_rules(tmp_path / "rules.yaml") in ({"docs": ("pdf", "txt")}, TAG_RULES)
    registry.write_tag_rules(tmp_path / "rules.yaml")
    assert "docs" in (tmp_path / "rules.yaml").read_text()
    registry.write_tag_rules(tmp_path / "rules.yaml", overwrite=True)
    assert registry.tag_rules(tmp_path / "rules.yaml") == TAG_RULES
    versions = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "c", 2), (4, "a", 1)], "id long, label string, hash_version int")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "a", "z")], "pair_id long, label_a string, label_b string")
    assert [tuple(r) for r in registry.differing_hash_versions(versions, pairs).collect()] == [(1, 2, 1)]
    (tmp_path / "rules.yaml").write_text("[broken")
    assert registry.tag_rules(tmp_path / "rules.yaml") == TAG_RULES == registry.tag_rules(None)


def test_a_drive_is_known_by_its_content(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(n * 10)
    rows = spark.createDataFrame([("a", 0, 10), ("b", 0, 10), ("gone", 0, 99), ("x/deep", 0, 500)], "rel_path string, is_dir int, size long")
    names, files = registry.fingerprint(rows)
    assert names == ["gone", "a", "b"] and files[0] == ("x/deep", 500)
    assert registry.matches_root(str(tmp_path), names, files)
    assert not registry.matches_root(str(tmp_path), ["gone"], files) and registry.matches_root(str(tmp_path), ["a"], [])
    assert not registry.matches_root(str(tmp_path), names, [("a", 11)])
    assert registry.matches_root(str(tmp_path), [], [("a", 10)]) and not registry.matches_root(str(tmp_path), [], [])


def test_links_and_failed_reads_are_not_sampled(spark):
    rows = [("f", 1, None, 0, None), ("big", 0, 9, 0, None), ("link", 0, 99, 1, None), ("bad", 0, 98, 0, "denied"), ("none", 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "rel_path string, is_dir int, size long, is_symlink int, error string")
    names, files = registry.fingerprint(df)
    assert names[0] == "f" and files == [("big", 9)]


def test_a_drive_is_found_where_it_is_mounted_now(spark, tmp_path):
    for place in ("decoy", "disk/Backups"):
        (tmp_path / place).mkdir(parents=True)
    (tmp_path / "decoy/a").write_text("x")
    for n in ("a", "Ac\u0327a\u0303o.txt"):
        (tmp_path / "disk/Backups" / unicodedata.normalize("NFC", n)).write_text("0123456789")
    df = spark.createDataFrame([("a", 0, 10), ("Ac\u0327a\u0303o.txt", 0, 10)], "rel_path string, is_dir int, size long")
    candidates = [str(tmp_path / "decoy"), str(tmp_path / "disk")]
    assert registry.resolve_root(df, "/Volumes/X/Backups", candidates) == str(tmp_path / "disk/Backups")
    assert registry.resolve_root(df, "/Volumes/X/Backups", candidates[:1]) == "/Volumes/X/Backups"
    assert registry.resolve_root(df, str(tmp_path / "disk/Backups"), []) == str(tmp_path / "disk/Backups")
    assert registry.resolve_root(df.where("false"), "/gone", candidates) == "/gone"
    inside = {"/Volumes/X": [], "/Volumes/X/B/2020": ["B/2020"], "E:\\B": ["B"], "E:\\": [], "/media/u/X/sub": ["X/sub", "sub"], "/run/media/u/X/sub": ["sub"], "/home/u": []}
    assert {r: registry.paths_in_volume(r) for r in inside} == inside


def test_an_indexed_folder_is_searched_and_reported(spark, tmp_path, capsys):
    from shelfmark.cli import main
    from shelfmark.inventory import load
    from shelfmark.operators.duplicates import file_groups

    root, store = tmp_path / "drive", str(tmp_path / "store")
    (root / "sub").mkdir(parents=True)
    for n in ("one.bin", "sub/two.bin"):
        (root / n).write_bytes(b"z" * 4000)
    (root / "sub/three.txt").write_text("3")

    def run(*command):
        assert main(["--tables", store, *command], spark) == 0
        return capsys.readouterr().out

    run("index", str(root), "--drive", "7", "--label", "Vault", "--at", "2024-01-01T00:00:00")
    (root / "four.txt").write_text("4444")
    run("snapshot", str(root), "--drive", "7", "--at", "2024-02-01T00:00:00")
    rows = load(spark, store)
    assert {(r.rel_path, r.drive) for r in rows.where("is_dir = 0").collect()} == {(p, "Vault") for p in ("one.bin", "sub/two.bin", "sub/three.txt", "four.txt")}
    assert [(r.n, r.confirmed) for r in file_groups(rows, 1).collect()] == [(2, False)]
    assert "hashed 2" in run("fill", str(root), "--drive", "7")
    assert [(r.n, r.confirmed) for r in file_groups(load(spark, store), 1).collect()] == [(2, True)]
    assert "two.bin" in run("find", "drive:vault", "*.bin", ">3KB") and "four.txt" in run("diff") and "added" in run("changes")
    (root / "sub/two.bin").write_bytes(b"y" * 4000)
    assert "corrupted" in run("verify", str(root), "--drive", "7")
    assert "Vault" in run("drives") and "|true" in run("cleanup", "--min-size", "1")
    run("refresh", str(root), "--drive", "7", "--at", "2024-02-02T00:00:00")
    run("compact", "--drive", "7", "--snapshot", "2")
    assert "[1]" in run("prune", "--drive", "7", "--as-of", "2024-03-01 00:00:00", "--keep-last", "1", "--keep-monthly", "0")
    assert {r.snapshot_id & 4095 for r in load(spark, store, latest_only=False).select("snapshot_id").distinct().collect()} == {2}
