from datetime import datetime

from shelfmark.operators.snapshot_changes import snapshot_changes

ENTRIES = "id long, drive_id long, snapshot_id long, path_id long, is_dir int, size long, partial_hash binary, loaded_at timestamp, drive string"
SNAPSHOTS = "id long, drive_id long, taken_at string, label string"


def day(n, hour=0):
    return datetime(2024, 1, n, hour)


def run(spark, entries, snapshots):
    e = spark.createDataFrame([(*r, "x") for r in entries], ENTRIES)
    s = spark.createDataFrame(snapshots, SNAPSHOTS)
    return sorted(tuple(r) for r in snapshot_changes(e, s).collect())


def stamps(*rows):
    return [(i, d, f"2024-01-{i:02d}T00:00:00", None) for i, d in rows]


def test_added_removed_changed_and_gaps(spark):
    # Drive 1 has snapshots 1, 3, 4 delivered; 2 never arrived; drive 2 has its own.
    snaps = stamps((1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2))
    rows = [
        (1, 1, 1, 10, 0, 5, b"a", day(1)), (2, 1, 3, 10, 0, 6, b"a", day(3)), (3, 1, 4, 10, 0, 6, b"a", day(4)),
        (4, 1, 1, 11, 0, 5, None, day(1)), (5, 1, 3, 11, 0, 5, b"z", day(3)),
        (6, 1, 1, 12, 0, None, None, day(1)), (7, 1, 3, 12, 0, None, None, day(3)), (8, 1, 4, 12, 0, None, None, day(4)),
        (9, 1, 1, 13, 0, 1, b"q", day(1)), (10, 1, 4, 13, 0, 1, b"q", day(4)),
        (11, 2, 5, 10, 0, 9, b"a", day(5)), (12, 2, 6, 11, 0, 9, b"a", day(6)),
    ]
    assert run(spark, rows, snaps) == [
        (3, 10, "changed"), (3, 11, "changed"), (3, 13, "removed"), (4, 11, "removed"), (4, 13, "added"), (6, 10, "removed"), (6, 11, "added"),
    ]


def test_corrected_deliveries_ties_and_folders(spark):
    snaps = stamps((1, 1), (2, 1))
    rows = [
        (1, 1, 1, 10, 0, 5, b"a", day(1)), (2, 1, 2, 10, 0, 7, b"a", day(2)), (3, 1, 2, 10, 0, 5, b"a", day(9)),
        (4, 1, 1, 11, 0, 5, b"a", day(1)), (5, 1, 2, 11, 0, 5, b"a", day(2)), (6, 1, 2, 11, 0, 8, b"a", day(2)),
        (7, 1, 1, 12, 0, 5, b"a", day(1)), (8, 1, 2, 12, 1, None, None, day(2)),
        (9, 1, 1, 13, 0, 5, b"a", None), (10, 1, 1, 13, 0, 6, b"a", day(1)), (11, 1, 2, 13, 0, 6, b"a", day(2)),
        (12, 1, 1, None, 0, 5, b"a", day(1)), (13, 1, None, 14, 0, 5, b"a", day(1)), (14, 1, 99, 14, 0, 5, b"a", day(1)),
    ]
    assert run(spark, rows, snaps) == [(2, 11, "changed"), (2, 12, "removed")]


def test_order_follows_taken_at_and_empty_tables(spark):
    snaps = [(1, 1, "2024-02-01T00:00:00", None), (2, 1, "2024-01-01T00:00:00", None)]
    rows = [(1, 1, 1, 10, 0, 5, b"a", day(1)), (2, 1, 2, 11, 0, 5, b"a", day(1))]
    assert run(spark, rows, snaps) == [(1, 10, "added"), (1, 11, "removed")]
    assert run(spark, [], snaps) == []
    assert run(spark, rows, []) == []


def test_many_repeated_deliveries_of_one_path(spark):
    rows = [(i, 1, 1 + i % 2, 10, 0, i, b"a", day(1)) for i in range(3000)]
    assert run(spark, rows, stamps((1, 1), (2, 1))) == [(2, 10, "changed")]
