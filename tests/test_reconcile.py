import random

import numpy as np
import pytest

from shelfmark.functions import field61
from shelfmark.operators.reconcile import copy_differences, field_differences

P = field61.P


def test_field_products_match_integers():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, P, 500, dtype=np.uint64) for _ in range(2))
    edge = np.array([0, 1, P - 1, P - 2, 2**31, 2**60], np.uint64)
    a, b = np.r_[a, np.repeat(edge, 6)], np.r_[b, np.tile(edge, 6)]
    assert field61.mul(a, b).tolist() == [int(x) * int(y) % P for x, y in zip(a, b)]
    rows, starts = rng.integers(0, P, (23, 3), dtype=np.uint64), np.array([0, 1, 8, 20])
    expected = []
    for s, e in zip(starts, [1, 8, 20, 23]):
        expected.append([__import__("functools").reduce(lambda x, y: x * int(y) % P, rows[s:e, c], 1) for c in range(3)])
    assert field61.segment_products(rows, starts).tolist() == expected


@pytest.mark.parametrize("only_a,only_b,bound,found", [(0, 0, 4, True), (3, 0, 4, True), (0, 3, 4, True), (2, 5, 8, True), (4, 4, 8, False), (9, 0, 8, False), (20, 11, 32, True)])
def test_reconcile_finds_differences_up_to_its_bound(only_a, only_b, bound, found):
    random.seed(only_a * 100 + only_b)
    common, a, b = ([random.randrange(field61.POINTS_FROM) for _ in range(n)] for n in (30, only_a, only_b))
    zs = [int(z) for z in field61.sample_points(bound + 2)]

    def at(elements):
        out = []
        for z in zs:
            v = 1
            for e in elements:
                v = v * (z - e) % P
            out.append(v)
        return out

    got = field61.reconcile(at(common + a), at(common + b), 30 + only_a, 30 + only_b, bound, 2)
    assert (got is not None) == found
    if found:
        for poly, mine in zip(got, (a, b)):
            assert len(poly) == len(mine) + 1
            tested = np.array(common + mine, np.uint64)
            hits = field61.vanishes(tested, np.tile(np.array(poly[::-1], np.uint64), (len(tested), 1)))
            assert hits.tolist() == [False] * 30 + [True] * len(mine)


SCHEMA = "job long, side int, k long, v long, w string, h long"


def brute(rows):
    a, b = ({(j, k): (v, w) for j, s, k, v, w, _ in rows if s == side and k is not None} for side in (0, 1))
    out = set()
    for j, k in a.keys() | b.keys():
        if (j, k) not in b:
            out.add((j, k, "only_a"))
        elif (j, k) not in a:
            out.add((j, k, "only_b"))
        else:
            (v, w), (x, y) = a[j, k], b[j, k]
            if v != x:
                out.add((j, k, "v"))
            if w is not None and y is not None and w != y:
                out.add((j, k, "w"))
    return out


@pytest.mark.parametrize("share,options", [(0.02, {}), (0.3, {"first_bound": 2, "bucket_rows": 16}), (1.0, {"first_bound": 4})])
def test_differences_match_brute_force(spark, share, options):
    random.seed(3)
    rows = []
    for job in (1, 2):
        for k in range(600):
            v, w = random.choice([None, k, 7]), random.choice([None, "x", "é"])
            other = (random.choice([None, k, 8]), random.choice([None, "x", "y"])) if random.random() < share else (v, w)
            kind = random.random()
            if kind > share / 3:
                rows.append((job, 0, k, v, w, 0))
            if not share / 3 < kind < share / 2:
                rows.append((job, 1, k, *other, 0))
    rows += [(1, 0, None, 1, "n", 0), (3, 0, 1, 1, "alone", 0)]
    got = [tuple(r) for r in field_differences(spark.createDataFrame(rows, SCHEMA).repartition(6), ["k"], {"v": True, "w": False}, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_copies(spark):
    assert field_differences(spark.createDataFrame([], SCHEMA), ["k"], {"v": True}).count() == 0


def test_pairs_by_label(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    entries = spark.createDataFrame(
        [(1, 1, 1, 10, 0, 5, b"a", b"f", t), (2, 2, 2, 10, 0, 6, b"a", None, t), (3, 2, 2, 11, 0, 6, b"a", None, t), (4, 3, 3, 10, 1, None, None, None, t)],
        "id long, drive_id long, snapshot_id long, path_id long, is_dir int, size long, partial_hash binary, full_hash binary, loaded_at timestamp",
    )
    snaps = spark.createDataFrame([(i, i, "2024-01-01T00:00:00", "s") for i in (1, 2, 3)], "id long, drive_id long, taken_at string, label string")
    drives = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None), (5, "A")], "id long, label string")
    pairs = spark.createDataFrame([(1, "A", "B"), (2, "A", None), (3, "A", "nobody"), (4, "B", "C"), (5, "A", "A")], "pair_id long, label_a string, label_b string")
    got = {tuple(r) for r in copy_differences(entries, snaps, drives, pairs).collect()}
    assert got == {(1, 10, "size"), (1, 11, "only_b"), (4, 10, "only_a"), (4, 11, "only_a")}
