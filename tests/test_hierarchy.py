import random

import pytest

from shelfmark.operators.hierarchy import broken_links, build_hierarchy, descendants, link_defects

SCHEMA = "id long, parent_id long, segment string, state string"


def model(rows):
    up, name = {}, {}
    for i, p, s, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")):
        if i not in up:
            up[i], name[i] = p, s
    out = {}
    for i in up:
        chain, at = [i], up[i]
        while at is not None and at in up and at not in chain:
            chain.append(at)
            at = up[at]
        if at is None:
            names = [name[k] for k in reversed(chain)]
            out[i] = ("sound", len(chain) - 1, chain[-1], None if None in names else "/".join(names))
        elif at == i:
            out[i] = ("cycle", None, None, None)
        elif up[i] is not None and up[i] not in up:
            out[i] = ("orphan", None, None, None)
        else:
            out[i] = ("below", None, None, None)
    return out, up


def forest(n, seed):
    random.seed(seed)
    rows = []
    for i in range(1, n + 1):
        kind = random.random()
        parent = None if kind < 0.05 else random.choice([i, i + 3, n + 5]) if kind < 0.08 else max(1, random.randint(i // 3, i))
        rows.append((i, parent, random.choice(["a", "b", "ç", None, "", "x/y"]) if kind > 0.9 else f"s{i}", "s"))
    return rows


@pytest.mark.parametrize("seed", [10**6, 20, 0])
def test_matches_a_walk(spark, seed):
    rows = forest(400 if seed > 20 else 120, seed) + [(None, 1, "n", "s"), (7, 3, "zz", "s"), (7, None, "zz", "s")]
    got = {r.id: (r.state, r.depth, r.root, r.path) for r in build_hierarchy(spark.createDataFrame(rows, SCHEMA).repartition(5), name_col="segment").collect()}
    assert got == model(rows)[0]
    frame = spark.createDataFrame(rows, SCHEMA).drop("segment")
    assert {(r.id, r.state) for r in broken_links(frame).collect()} == {(i, m[0]) for i, m in got.items() if m[0] != "sound"}


def test_sizes_descendants_and_a_long_chain(spark):
    rows = [(i, i - 1 if i > 1 else None, f"d{i}", "s") for i in range(1, 300)] + [(10_000 + i, 5, "leaf", "s") for i in range(50)]
    tree = build_hierarchy(spark.createDataFrame(rows, SCHEMA), name_col="segment", chains=True)
    n = len(rows)
    below = {r.id: r.below_n for r in tree.collect()}
    assert below[1] == n - 1 and below[5] == n - 5 and below[10_000] == 0
    pairs = {(r.ancestor, r.descendant): r.distance for r in descendants(tree).collect()}
    assert len(pairs) == sum(below.values()) and pairs[(1, 5)] == 4 and pairs[(5, 10_007)] == 1


def test_long_circles_with_chains_below_and_levels(spark):
    ring = [(i, (i + 1) % 40, f"r{i}", "s") for i in range(40)]
    tail = [(100 + i, 99 + i if i else 7, "t", "s") for i in range(30)]
    stray = [(200 + i, 199 + i if i else 999, "o", "s") for i in range(30)]
    got = {r.id: (r.state, r.level, r.below_n) for r in build_hierarchy(spark.createDataFrame(ring + tail + stray, SCHEMA)).collect()}
    assert got == {
        **{i: ("cycle", 0, None) for i in range(40)},
        **{100 + i: ("below", i + 1, 29 - i) for i in range(30)},
        **{200 + i: ("orphan" if i == 0 else "below", i, 29 - i) for i in range(30)},
    }


def test_roots_only_ties_and_clashing_columns(spark):
    rows = [(1, None, "b", 9, 9), (2, None, None, 9, 9), (1, None, "a", 9, 9), (None, None, "n", 9, 9)]
    df = spark.createDataFrame(rows, "id long, parent_id long, segment string, tree long, up long")
    got = {r.id: (r.state, r.depth, r.level, r.root, r.path, r.below_n, r.chain) for r in build_hierarchy(df, name_col="segment", chains=True).collect()}
    assert got == {1: ("sound", 0, 0, 1, "a", 0, [1]), 2: ("sound", 0, 0, 2, None, 0, [2])}
    assert broken_links(df).count() == 0 and descendants(build_hierarchy(df, chains=True)).count() == 0
    pair = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (3, 3, "z"), (4, 5, "v"), (5, None, "w")], SCHEMA.replace(", state string", ""))
    assert {r.id: (r.state, r.path, r.below_n) for r in build_hierarchy(pair, name_col="segment").collect()} == {
        1: ("cycle", None, None), 2: ("cycle", None, None), 3: ("cycle", None, None), 4: ("sound", "w/v", 0), 5: ("sound", "w", 1),
    }


def test_a_folder_that_holds_most_nodes(spark):
    rows = [(0, None, "r", "s"), (1, 0, "hot", "s")] + [(i, 1, "f", "s") for i in range(2, 3000)] + [(10_000 + i, i, "g", "s") for i in range(2, 40)]
    got = {r.id: (r.depth, r.below_n) for r in build_hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (1, 2998 + 38) and got[0] == (0, 2998 + 39) and got[10_002] == (3, 0) and len(got) == len(rows)


def test_defects_of_both_tables_and_empty_ones(spark):
    paths = spark.createDataFrame(
        [(1, None, "a", "a"), (2, 1, "b", "a/B"), (3, 1, "c", None), (4, 4, "d", "d"), (5, 4, "e", "x"), (6, 99, "f", "f"), (7, 6, "g", "g"), (8, 1, None, "a/h")],
        "id long, parent_id long, segment string, full_path string",
    )
    entries = spark.createDataFrame([(1, 2, "q"), (2, 1, "q"), (3, 2, "q"), (4, None, "q")], "id long, parent_id long, segment string")
    got = {tuple(r) for r in link_defects(paths, entries).collect()}
    assert got == {
        ("paths", 2, "stale_path"), ("paths", 4, "cycle"), ("paths", 5, "below"), ("paths", 6, "orphan"), ("paths", 7, "below"),
        ("entries_core", 1, "cycle"), ("entries_core", 2, "cycle"), ("entries_core", 3, "below"),
    }
    assert link_defects(paths.where("false"), entries.where("false")).count() == 0
