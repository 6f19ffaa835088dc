import random
from datetime import datetime

from pyspark.sql import functions as F

from shelfmark.llm.survivors import Attribute, golden_entries, survivors, surviving_entries

ENTRIES = "id long, drive_id long, snapshot_id long, path_id long, is_dir int, size long, mtime double, full_hash binary, inode long, device long, loaded_at timestamp, content string"
T = datetime(2024, 1, 2)
TAKEN = 1704067200.0  # 2024-01-01


def tables(spark, rows):
    entries = spark.createDataFrame([(*r, T, "x") for r in rows], ENTRIES)
    snaps = spark.createDataFrame([(i, i, "2024-01-01T00:00:00", None) for i in (1, 2, 3)], "id long, drive_id long, taken_at string, label string")
    return entries, snaps


def test_rules_of_the_surviving_row(spark):
    rows = [
        # a: complete beats recent
        (1, 1, 1, 1, 0, 5, 100.0, b"a", 7, 1), (2, 2, 2, 2, 0, 5, 200.0, b"a", None, 1),
        # b: latest usable time; a future and a zero time aren't usable
        (3, 1, 1, 3, 0, 5, 50.0, b"b", 8, 1), (4, 1, 1, 4, 0, 5, 60.0, b"b", 9, 1), (5, 2, 2, 5, 0, 5, TAKEN + 1, b"b", 9, 1), (6, 2, 2, 6, 0, 5, 0.0, b"b", 10, 1),
        # c: one physical copy under two names
        (7, 1, 1, 7, 0, 5, 1.0, b"c", 11, 1), (8, 1, 1, 8, 0, 5, 1.0, b"c", 11, 1),
        # d: ties go to the lowest id; the same inode on another drive is another copy
        (9, 1, 1, 9, 0, 5, 1.0, b"d", 12, 1), (10, 2, 2, 10, 0, 5, 1.0, b"d", 12, 1),
        # e: rows without inode are copies of their own, NaN isn't a usable time
        (11, 1, 1, 11, 0, 5, float("nan"), b"e", None, None), (12, 1, 1, 12, 0, 5, -3.0, b"e", None, 1),
        # f: a single row, a folder, and a row without a hash
        (13, 1, 1, 13, 0, 5, 1.0, b"f", 1, 1), (14, 1, 1, 14, 1, None, 1.0, b"f", 2, 1), (15, 1, 1, 15, 0, 5, 1.0, None, 3, 1),
    ]
    got = {bytes.fromhex(r.full_hash): r.keep_id for r in surviving_entries(*tables(spark, rows)).collect()}
    assert got == {b"a": 1, b"b": 4, b"d": 9, b"e": 11}


def test_golden_record_takes_each_field_from_its_best_row(spark):
    rows = [(1, 1, 1, 1, 0, 5, 100.0, b"a", None, 1), (2, 2, 2, 2, 0, None, 300.0, b"a", 4, 2), (3, 3, 3, 3, 0, 6, None, b"a", None, None)]
    (r,) = golden_entries(*tables(spark, rows)).collect()
    assert tuple(r)[1:] == (300.0, 2, 4, 2, 5, 1)


def test_empty_tables(spark):
    entries, snaps = tables(spark, [])
    assert surviving_entries(entries, snaps).count() == 0 and golden_entries(entries, snaps.where("false")).count() == 0


def test_matches_a_loop_on_a_hot_key(spark):
    random.seed(2)
    rows = [(random.choice(["hot", "hot", None, f"k{i % 40}"]), i, random.choice([None, "a", "b"]), random.randint(0, 3), random.randint(0, 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, v string, trust int, copy int").repartition(6)
    got = {r.k: (r.v, r.id) for r in survivors(df, ["k"], {"v": Attribute(F.col("v"), (F.col("trust"),)), "id": Attribute(F.col("id"), (-F.col("id"),))}, [F.col("copy")]).collect()}
    want = {}
    for k in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == k]
        if len({r[4] for r in mine}) > 1:
            best = max(((r[3], r[2]) for r in mine if r[2] is not None), default=(None, None))
            want[k] = (best[1], min(r[1] for r in mine))
    assert got == want
