import random
from collections import Counter, defaultdict

import pytest

from shelfmark.llm.packing import pack, packing_summary, plan_containers


def check_plan(counts, capacity):
    placed, total = plan_containers(dict(counts), capacity)
    load, seen = Counter(), Counter()
    for length, low, n, first, k in placed:
        assert low == seen[length]
        seen[length] += n
        for i in range(n):
            load[first + i % k] += length
    assert seen == Counter({k: v for k, v in counts.items() if v})
    assert set(load) == set(range(total)) and all(v <= capacity for v in load.values())
    return total


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold_every_item_once(seed):
    random.seed(seed)
    capacity = random.choice([1, 2, 3, 10, 64, 257])
    counts = Counter(random.randint(1, capacity) for _ in range(random.choice([0, 1, 5, 400])))
    total = check_plan(counts, capacity)
    assert total >= -(-sum(k * v for k, v in counts.items()) // capacity)


def first_fit_decreasing(counts, capacity):
    bins = []
    for x in sorted(counts.elements(), reverse=True):
        for i, free in enumerate(bins):
            if free >= x:
                bins[i] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_no_worse_than_first_fit_decreasing(seed):
    random.seed(seed)
    counts = Counter(min(100, max(1, int(random.lognormvariate(3, 0.8)))) for _ in range(600))
    assert check_plan(counts, 100) <= first_fit_decreasing(counts, 100)


def test_exact_complements_are_found():
    assert check_plan(Counter({60: 5, 40: 5}), 100) == 5  # one other
    assert check_plan(Counter({50: 4, 30: 4, 20: 4}), 100) == 4  # two others
    assert check_plan(Counter({52: 3, 20: 3, 17: 3, 11: 3}), 100) == 3  # three others
    assert check_plan(Counter({25: 8}), 100) == 2
    with pytest.raises(ValueError):
        plan_containers({11: 1}, 10)


def verify(rows, sizes, capacities):
    by_item, by_bin = defaultdict(list), Counter()
    for kind, container, doc, piece, start, length in rows:
        by_item[kind, doc].append((piece, start, length))
        by_bin[kind, container] += length
        assert container >= 0
    for kind, capacity in capacities:
        for doc, n in sizes.items():
            pieces = sorted(by_item[kind, doc])
            assert [p[0] for p in pieces] == list(range(max(1, -(-n // capacity))))
            assert [p[1] for p in pieces] == [i * capacity for i in range(len(pieces))]
            assert sum(p[2] for p in pieces) == n and all(p[2] == capacity for p in pieces[:-1])
        assert all(v <= capacity for (k, _), v in by_bin.items() if k == kind)
        used = {c for k, c in by_bin if k == kind}
        assert used == set(range(len(used)))


def test_packing_a_skewed_table(spark):
    random.seed(1)
    sizes = {i: random.choice([0, 7, 7, 7, 7, random.randint(1, 30), random.randint(1, 300)]) for i in range(900)}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], "doc_id long, n_tokens long, container string").repartition(6)
    kinds = [("small", 16), ("large", 128)]
    containers = spark.createDataFrame([*kinds, ("none", 0), ("null", None)], "container_kind string, capacity_tokens long")
    packed = pack(df, containers)
    verify([tuple(r) for r in packed.collect()], sizes, kinds)
    for r in packing_summary(packed, containers).collect():
        assert r.n_tokens == sum(sizes.values()) and r.least <= r.n_containers <= r.least * 1.02 + 1


def test_nulls_empty_tables_and_only_empty_items(spark):
    schema, caps = "doc_id long, n_tokens long", spark.createDataFrame([("k", 10)], "container_kind string, capacity_tokens long")
    assert pack(spark.createDataFrame([], schema), caps).count() == 0
    assert pack(spark.createDataFrame([(1, 5)], schema), caps.where("false")).count() == 0
    got = [tuple(r) for r in pack(spark.createDataFrame([(1, None), (None, 0), (2, 0), (2, 0)], schema), caps).collect()]
    assert [r[1] for r in got] == [0] * 4 and [r[5] for r in got] == [0] * 4


def test_more_kinds_than_are_packed_together(spark, monkeypatch):
    from shelfmark.llm import packing

    monkeypatch.setattr(packing, "KINDS_AT_ONCE", 2)
    random.seed(2)
    sizes = {i: random.randint(0, 90) for i in range(120)}
    kinds = [(f"k{c}", c) for c in (5, 16, 33, 64, 100)]
    df = spark.createDataFrame([(i, n) for i, n in sizes.items()], "doc_id long, n_tokens long")
    rows = [tuple(r) for r in packing.pack(df, spark.createDataFrame(kinds, "container_kind string, capacity_tokens long")).collect()]
    verify(rows, sizes, kinds)
    assert {r[0] for r in rows} == {k for k, _ in kinds}


def test_a_large_capacity_is_planned_in_time():
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(5.5, 1.1, 1_000_000), 1, 32_768).astype(int)
    counts = Counter(lengths.tolist())
    began = time.perf_counter()
    placed, total = plan_containers(dict(counts), 32_768)
    assert time.perf_counter() - began < 10
    assert total <= -(-int(lengths.sum()) // 32_768) + 1 and sum(p[2] for p in placed) == len(lengths)
